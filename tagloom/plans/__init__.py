"""End-to-end jobs: build a corpus, train, evaluate, tune and predict."""
