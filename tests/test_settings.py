import pytest

from tagloom import settings


def test_layers(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("seed: 7\nmodel:\n  max_length: 256\nextra: {a: 1}\n")
    got = settings.load_settings(path, {"model": {"name": "x/y"}, "data": {"dedup": False}})
    assert got["seed"] == 7 and got["extra"] == {"a": 1}
    assert got["model"]["max_length"] == 256 and got["model"]["name"] == "x/y"
    assert got["model"]["head_ratio"] == 0.6 and got["data"]["dedup"] is False
    assert settings.DEFAULTS["data"]["dedup"] is True


def test_files():
    assert settings.load_settings() == settings.DEFAULTS
    with pytest.raises(FileNotFoundError):
        settings.load_settings("/nowhere/c.yaml")


def test_empty_file_and_dump(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("")
    got = settings.load_settings(path)
    assert got == settings.DEFAULTS
    path.write_text(settings.dump(got))
    assert settings.load_settings(path) == got
    assert settings.dump(got).startswith("seed:")


def test_merge_copies():
    base = {"a": {"b": [1]}}
    out = settings.merged(base, {"a": {"c": 2}})
    out["a"]["b"].append(9)
    assert base == {"a": {"b": [1]}} and out["a"]["c"] == 2
    assert settings.merged({"a": {"b": 1}}, {"a": 5}) == {"a": 5}
