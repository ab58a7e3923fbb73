import hashlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tagloom.functions import text

V = F.col("v")


def test_white_space_is_what_python_strips():
    assert sorted(text.WHITE_SPACE) == [chr(c) for c in range(0x110000) if chr(c).isspace()]


def test_clean_code(values):
    items = [
        "a\r\nb", "a\rb", "  \n code \n  ", None, "a\n\n\nb", "// note\nx=1",
        "def f():\n    pass", "", "\r\n\r", text.WHITE_SPACE + "é 😀" + text.WHITE_SPACE, "a\r\r\nb",
    ]
    want = [
        "a\nb", "a\nb", "code", "", "a\n\n\nb", "// note\nx=1",
        "def f():\n    pass", "", "", "é 😀", "a\n\nb",
    ]
    assert values(text.clean_code(V), items, "string") == want


def test_clean_code_matches_python_and_is_idempotent(values):
    alphabet = st.sampled_from(list("ab \t\r\n") + [" ", "\x85", "é", "😀"])

    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.text(alphabet, max_size=12), min_size=20, max_size=60))
    def check(items):
        want = [s.replace("\r\n", "\n").replace("\r", "\n").strip() for s in items]
        assert values(text.clean_code(V), items, "string") == want
        assert values(text.clean_code(V), want, "string") == want

    check()


@pytest.mark.parametrize(
    "raw, want",
    [
        ("CWE-79", "CWE-79"), ("79", "CWE-79"), ("cwe_79", "CWE-79"), ("CWE-079", "CWE-79"),
        (None, ""), ("nan", ""), ("NVD-CWE-noinfo", ""), ("NVD-CWE-Other", ""), ("CWE-noinfo", ""),
        ("  cwe-89  ", "CWE-89"), ("", ""), ("  ", ""), ("none", ""), ("79.0", "CWE-790"),
        ("CWE-79,CWE-89", "CWE-7989"), ("CWE-000", "CWE-0"), ("CVE-2023-1", "CWE-20231"),
        (" cwe 5　", "CWE-5"),
    ],
)
def test_class_ids(values, raw, want):
    assert values(text.normalize_class_id(V), [raw], "string") == [want]


def test_truncate_middle(values):
    cut = text.truncate_middle(V, 10, 0.6)
    items = ["abc", "a" * 10, "", None, "0123456789X", "éàüöñ😀ßçøåÆ"]
    got = values(cut, items, "string")
    assert got[:4] == ["abc", "a" * 10, "", ""]
    assert got[4] == "012345" + text.CUT_MARK + "789X"
    assert got[5] == items[5][:6] + text.CUT_MARK + items[5][-4:]
    assert len(got[4]) == 10 + len(text.CUT_MARK)


def test_truncate_rejects_ratios_without_a_tail():
    for bad in (1.0, -0.1, 2.0):
        with pytest.raises(ValueError):
            text.truncate_middle(V, 10, bad)
    with pytest.raises(ValueError):
        text.truncate_middle(V, 0)


def test_fingerprint(values):
    items = ["x", "é 😀", ""]
    want = [hashlib.md5(s.encode()).hexdigest() for s in items]
    assert values(text.fingerprint(V), items, "string") == want


def test_identifiers(values):
    assert values(text.last_url_segment(V), ["http://h/a/b", "h/a/", "x", None], "string") == ["b", "", "x", ""]
    assert values(text.group_key("s", V, F.lit("h")), ["c", None], "string") == ["s::c::h", "s::None::h"]
    assert values(text.sample_id(V, "vuln"), ["c", None], "string") == ["c-vuln", "None-vuln"]


def test_formats(values):
    assert values(text.thousands(V), [15147, 3, 0], "long") == ["15,147", "3", "0"]
    assert values(text.four_decimals(V), [0.91234, 1.0], "double") == ["0.9123", "1.0000"]
    assert text.path_safe("a/b") == "a__b" and text.last_path_part("a/b") == "b"
