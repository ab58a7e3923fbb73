"""Labelled-text analytics on Spark: corpus preparation, model-input
preparation, class-imbalance statistics, classifier evaluation, threshold
tuning and batch scoring, all expressed as DataFrame plans."""

__version__ = "0.1.0"
