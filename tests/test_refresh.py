"""Discovery again, next to whole runs on the same captures."""

import pytest
from pyspark.sql import functions as F

from pagesift.plans import discover
from pagesift.plans.refresh import DiscoveryState, refresh
from pagesift.sources.rules import Rules

RULES = Rules(categories=[("Books", "#a"), ("Games", "#c")])
DDL = "capture_id bigint, url string, html string, elapsed_ms bigint"
PROBES = ["asdfghjklqwerty12345", "sherlock", "harry+potter"]


def entries(*sites, heading="a"):
    return f"<h2 id={heading}>A</h2><ul>" + "".join(f"<li><a href='https://{s}.org'>{s}</a>" for s in sites) + "</ul>"


def form(name="q"):
    return f"<form action=/find><input type=search name={name}></form>"


def cards(tag, *names):
    return "<div id=r>" + "".join(f"<{tag} class=card><a href='/p/{n}'></a><h2>{n}</h2></{tag}>" for n in names) + "</div>"


def site(name, first, tag="div", ms=10, field="q"):
    pages = ["<p>none", cards(tag, "one", "two"), cards(tag, "three", "four")]
    probes = [(first + 1 + i, f"https://{name}.org/find?{field}={q}", p, ms) for i, (q, p) in enumerate(zip(PROBES, pages))]
    return [(first, f"https://{name}.org", form(field), ms), *probes]


class World:
    def __init__(self, spark, path):
        self.spark, self.rows, self.report, self.state = spark, [], {}, DiscoveryState(spark, path)
        self.pages = spark.createDataFrame([("https://dir", 0), ("https://gone", 1)], "url string, page_ord bigint")

    def run(self, *more, rules=RULES):
        """One more run, equal to a whole run (without new captures: to the last one); gives the pages it parsed."""
        self.rows += more
        captures = self.spark.createDataFrame(self.rows, DDL)
        got = refresh(captures, self.pages, rules, self.state)
        before, self.report = self.report, {r.url: r for r in got.report.collect()}
        if more:
            whole = discover.discovery_report(captures, self.pages, rules)
            assert got.report.columns == whole.columns and self.report == {r.url: r for r in whole.collect()}
        elif rules is RULES:
            assert self.report == before
        return sorted((r.stage, r.capture_id) for r in got.parsed.collect())


@pytest.fixture
def world(spark, tmp_path):
    return World(spark, str(tmp_path / "state"))


def all_of(first, *stages):
    return [("cards", first + i) for i in (1, 2, 3)] + [("form", first)]


def test_only_what_changed_is_parsed(world):
    first = world.run((1, "https://dir", entries("x", "y", "lost"), 1), *site("x", 10), *site("y", 20))
    assert first == sorted([("directory", 1), *all_of(10), *all_of(20)])
    assert world.report["https://x.org"].selector == "div#r > div.card"
    assert world.report["https://lost.org"].reject_reason == "no_capture"
    assert world.run() == []
    # Fetched again, same texts: nothing to parse, but the times are new.
    assert world.run(*site("x", 100, ms=31)) == []
    assert world.report["https://x.org"].response_time == 31
    # One probe shows other cards: the three probes of that site.
    other = (203, "https://y.org/find?q=sherlock", cards("li", "five", "six"), 10)
    assert world.run(other) == [("cards", 21), ("cards", 23), ("cards", 203)]
    assert world.report["https://y.org"].selector == "div#r > li.card"
    # A new form asks for other probe pages.
    assert world.run(*site("x", 300, tag="li", field="s")) == all_of(300)
    assert (world.report["https://x.org"].search_url, world.report["https://x.org"].selector) == ("https://x.org/find?s={0}", "div#r > li.card")


def test_directories_change_and_deletes_propagate(world):
    world.run((1, "https://dir", entries("x", "y"), 1), *site("x", 10), *site("y", 20))
    # The directory page is parsed, the site that stays keeps what was found.
    assert world.run((2, "https://dir", entries("y"), 1)) == [("directory", 2)]
    assert set(world.report) == {"https://y.org"}
    assert world.state.forms.read().count() == 1 == world.state.cards.read().count()
    assert world.run((3, "https://dir", "<p>empty", 1)) == [("directory", 3)]
    assert world.report == {} and world.state.forms.read().count() == 0
    assert world.run() == []  # a page without links is known, too
    # It comes back: found anew.
    assert world.run((4, "https://dir", entries("x"), 1)) == sorted([("directory", 4), *all_of(10)])
    assert world.report["https://x.org"].selector == "div#r > div.card"


def test_rules_count_with_the_page(world):
    world.run((1, "https://dir", entries("x"), 1), *site("x", 10))
    strict = Rules(categories=RULES.categories, link_skip_words=["x.org"])
    assert world.run(rules=strict) == [("directory", 1)]
    assert world.report == {}


def test_equal_pages_are_one_and_nothing_captured_is_nothing(world):
    assert world.run((5, "https://elsewhere", "<p>", 1)) == []
    same = entries("x")
    assert world.run((6, "https://dir", same, 1), (7, "https://gone", same, 1), (8, "https://x.org", None, 1)) == [
        ("directory", 6), ("form", 8),
    ]
    assert world.report["https://x.org"].reject_reason == "no_page"


def test_a_known_page_body_is_not_read(spark, world):
    world.run((1, "https://dir", entries("x"), 1), *site("x", 10))
    broken = F.raise_error(F.lit("read")).cast("string")
    captures = spark.createDataFrame(world.rows, DDL).withColumn("html", F.when(F.col("capture_id") > 0, broken))
    got = refresh(captures, world.pages, RULES, world.state)
    assert got.report.filter("selector is not null").count() == 1 and got.parsed.count() == 0
