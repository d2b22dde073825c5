import random
import re

from sparkweave.llm import urls


def test_numbers_beside_letters_do_not_hide_a_token(spark):
    hosts = ["casino24.com", "casino7.x", "xcasino.com", "online-casino.de", "a.com/casino.html", "casino.net", "casino24x.com"]
    rows = [(i, f"http://{h}") for i, h in enumerate(hosts)]
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(spark.createDataFrame(rows, "page_id int, url string"), domain_rules=()).collect()}
    for i, u in rows:
        blocked = any(re.search(rx, u) for _, rx in urls.PATTERN_RULES)
        assert (got[i] == "block") == blocked, u


def test_rules_whose_token_is_followed_by_digits(spark):
    hosts = ["casino24.com", "casino7.x", "casino2024.x", "my-casino1.org", "casinos.com", "24casino.com", "online-casino.com", "casino-win2.com", "porn", "porn1", "web2.shop9.com", "web2x.com"]
    rows = [(k, f"http://{h}/a1b2") for k, h in enumerate(hosts)]
    rules = [*urls.PATTERN_RULES, ("block", r"\bweb2\.shop9\.")]
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(spark.createDataFrame(rows, "page_id int, url string"), (), rules).collect()}
    assert got == {k: "block" if any(re.search(rx, u) for _, rx in rules) else "allow" for k, u in rows}
    assert got[0] == got[1] == got[2] == "block"


def test_a_path_is_no_part_of_the_host(spark):
    rows = [(0, "http://a.com/b.net /c"), (1, "http://b.net /c"), (2, "http://x.example.net/en/y"), (3, "http://example.net/enough"), (4, "http://net"), (5, "http://net/"), (6, "HTTP://A.NET/EN/"), (7, "http://aexample.com/de/"), (8, None), (9, "://org/fr/")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id int, url string")).collect()}
    assert got[0] == (None, "allow") and got[1] == (None, "allow") and got[2] == ("example.net/en/", "allow") and got[3] == ("net/", "block")
    assert got[4] == (None, "allow") and got[5] == ("net/", "block") and got[6] == ("net/", "block") and got[7] == (None, "allow") and got[8] == (None, "allow") and got[9] == ("org/fr/", "allow")


def test_tokens_are_read_off_the_expression():
    assert urls.literal_tokens(r"\bonline-casino\b|\bcasino\d*\.") == (("online", "casino"), ("casino",))
    assert urls.literal_tokens(r"foo") == ((),) and urls.literal_tokens(r"\bfoo\w*") == ((),) and urls.literal_tokens(r"\bfoo?\b") == ((),)
    assert urls.literal_tokens(r"\bab12-[xy]z\b") == (("ab", "12"),) and urls.literal_tokens(r"\d*\bab\d+c\b") == (("ab", "c"),)
    assert urls.literal_tokens(r"\b(?:ab|cd)-(ef)\b") == (("ab", "ef"), ("cd", "ef"))


def test_many_rules_against_all_expressions_on_all_urls(spark):
    """Rules with and without literal tokens, alternatives, and columns with clashing names."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 4))) for _ in range(60)]
    w = lambda: rng.choice(words)
    forms = [lambda: rf"\b{w()}-{w()}\b", lambda: rf"\b{w()}\d+\.", lambda: rf"\b{w()}\b|\b{w()}-\d*{w()}\b", lambda: rf"{w()}{w()}", lambda: rf"://[^/?#]*\b{w()}\d*[-.]", lambda: rf"/{w()}$"]
    rules = [(rng.choice(["block", "block", "allow"]), rng.choice(forms)()) for _ in range(150)]
    rows = [(i, f"http://{w()}{rng.choice(['', '-', '7', '.'])}{w()}.{w()}/{w()}{rng.choice(['', '-3', '/'])}{w()}", "x", "y", "z") for i in range(400)]
    docs = spark.createDataFrame(rows, "page_id int, url string, _url string, _tokens string, verdict string")
    out = urls.filter_urls(docs, domain_rules=(), pattern_rules=rules)
    assert out.columns[:4] == ["page_id", "url", "_url", "_tokens"] and out.filter("_url <> 'x' or _tokens <> 'y'").count() == 0
    got = {r["page_id"]: r["verdict"] for r in out.collect()}
    assert got == {i: "block" if any(re.search(x, u) for v, x in rules if v == "block") else "allow" for i, u, *_ in rows}
    assert urls.filter_urls(docs, domain_rules=(), pattern_rules=()).filter("verdict <> 'allow'").count() == 0
