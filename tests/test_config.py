import pytest

from siltloom.config import Reader, load_parameters, site_config, site_registry


def test_readers():
    r = Reader({"i": 5, "is": "12", "neg": "-3", "nint": -3, "b": True, "bs": " TrUe", "bi": 1, "s": "x", "n": " y ", "e": " ", "nil": None, "l": [3, "1", 2.9, "x", True], "ls": ["a", "", 1]})
    assert (r.int("i", 1), r.int("is", 1), r.int("neg", 1), r.int("nint", 1), r.int("b", 1), r.int("nil", 1), r.int("none", 1)) == (5, 12, 1, -3, 1, 1, 1)
    assert (r.bool("b", False), r.bool("bs", False), r.bool("bi", False), r.bool("none", True)) == (True, True, False, True)
    assert (r.string("s", "d"), r.string("i", "d")) == ("x", "d")
    assert (r.nullable_string("n"), r.nullable_string("e"), r.nullable_string("none"), r.nullable_string("i")) == ("y", None, None, None)
    assert r.int_list("l") == (1, 2, 3)
    assert r.string_list("ls") == ("a",)
    assert r.mixed_list("ls") == ("a", 1)
    assert ("warning", "none", "missing") in r.notes and ("error", "bi", "not a bool") in r.notes


def test_score_rules_and_start_urls():
    r = Reader({
        "content_scoring.positive": [{"score": "3", "match_any": ["a", "", 1]}, "no", {"condition": {"body_text_length_lt": "350"}}],
        "start_urls": ["https://a", {"url": "https://b", "extraction_depth": "2"}, {"url": 1}, {"url": "https://c", "extraction_depth": "x"}],
    })
    a, b = r.score_rules("content_scoring.positive")
    assert (a.score, a.match_any, b.score, b.body_text_length_lt) == (3, ("a",), 0, 350)
    assert r.score_rules("missing") == () and r.notes == []
    assert r.start_urls() == (("https://a", 0), ("https://b", 2), ("https://c", 0))


def test_site_config_and_yaml(tmp_path):
    (tmp_path / "page.yaml").write_text("parameters:\n  id: x\n  title.max_chars: 140\n  introText.present: 'true'\n  datetime.only-date: false\n")
    config, notes = site_config(load_parameters(tmp_path, "page"))
    assert (config.id, config.title.max_chars, config.intro.present, config.datetime.only_date) == ("x", 140, True, False)
    assert config.max_teaser == 100 and config.title.present and any(k == "max_teaser" for _, k, _ in notes)
    (tmp_path / "list.yaml").write_text("parameters: [1]\n")
    assert load_parameters(tmp_path, "list") == {}
    with pytest.raises(OSError):
        load_parameters(tmp_path, "none")
    assert site_registry({"sites": [{"siteKey": "a", "schedule": "* * * * *"}, 3]}) == [("a", "* * * * *")]
