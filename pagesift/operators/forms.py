"""Home page -> search form -> URL template.

All of it is page-local: a page row in, the same page row out with the forms,
their scored inputs and the chosen template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions import dom
from pagesift.functions.binding import computed, let
from pagesift.functions.text import is_blank, lower_chars
from pagesift.functions.urls import search_template

# Words that mark a form as something else, search icons, scored attributes; further below, the points and
# reason labels of the signals and of the bonus.
OTHER_FORM = r"(?iu)login|log in|sign ?in|username|password|register|sign ?up|subscribe|newsletter|contact|comment|forgot|e-mail|email"
SEARCH_ICON = r"(?i)search|magnify|loupe"
SEARCH_ATTRIBUTES = ["id", "name", "aria-label", "data-testid"]
SEARCH_NAMES = ["q", "s", "query"]

_TEXT_INPUTS = "input[type='search'], input[type='text']"
_LABELS = "h1, h2, h3, button, a[role='button'], input[type='submit']"
_BUTTONS = "button, a[role='button']"


def is_likely_search_form(form: Column) -> Column:
    """No password or textarea inside, and no heading or button that names another purpose.

    Submit inputs keep their label in ``value``, which is not text: it is not looked at.
    """
    labels = F.transform(dom.select(_LABELS, form), lambda e: F.concat(dom.text_content(e), F.lit(" ")))
    return ~dom.contains("input[type='password'], textarea", form) & ~F.array_join(labels, "").rlike(OTHER_FORM)


def is_get_form(form: Column) -> Column:
    return F.lower(F.coalesce(dom.attr(form, "method"), F.lit(""))).isin("", "get")


def _signals(e: Column, form: Column) -> Column:
    """Scored signals of one input: array<struct<points, reason, positive>>, null where absent."""

    def signal(test: Column, points: int, reason: str, positive: bool) -> Column:
        return F.when(
            test,
            F.struct(F.lit(points).alias("points"), F.lit(reason).alias("reason"), F.lit(positive).alias("positive")),
        )

    def attribute(name: str) -> Column:
        value = lower_chars(dom.attr(e, name))
        return F.coalesce(F.contains(value, F.lit("search")) | value.isin(SEARCH_NAMES), F.lit(False))

    is_search = F.lower(dom.attr(e, "type")) == "search"
    button = F.exists(
        dom.select(_BUTTONS, form),
        lambda b: dom.text_content(b).rlike("(?i)search")
        | F.coalesce(dom.attr(b, "class").rlike(SEARCH_ICON), F.lit(False)),
    )
    in_header = dom.has_closest("header", e)
    return F.array(
        signal(is_search, 100, "+100 (Base:type='search')", False),
        signal(~is_search, 10, "+10 (Base:type='text')", False),
        signal(dom.has_closest("[role='search']", e), 75, "+75 (in role='search')", True),
        signal(in_header, 50, "+50 (in <header>)", True),
        signal(~in_header & dom.has_closest("nav", e), 40, "+40 (in <nav>)", True),
        *[signal(attribute(a), 35, f"+35 (attr {a})", True) for a in SEARCH_ATTRIBUTES],
        signal(
            F.coalesce(dom.attr(e, "placeholder").rlike("(?i)search"), F.lit(False)), 20, "+20 (placeholder)", False
        ),
        signal(button, 50, "+50 (adj. btn match)", True),
        signal(dom.has_closest("footer", e), -200, "-200 (in <footer>)", False),
        signal(dom.has_closest("aside, .sidebar", e), -100, "-100 (in sidebar)", False),
    )


def input_score(e: Column, form: Column) -> Column:
    """struct(score, reasons): the weighted signals, +50 when at least three are positive."""

    def total(found: Column) -> Column:
        bonus = F.size(F.filter(found, lambda s: s["positive"])) >= 3
        points = F.aggregate(found, F.lit(0), lambda acc, s: acc + s["points"])
        reasons = F.transform(found, lambda s: s["reason"])
        return F.struct(
            (points + F.when(bonus, 50).otherwise(0)).alias("score"),
            F.when(bonus, F.array_append(reasons, F.lit("+50 (Certainty Bonus)"))).otherwise(reasons).alias("reasons"),
        )

    return let(F.filter(_signals(e, form), lambda s: s.isNotNull()), total)


def _form_facts() -> Column:
    def facts(form: Column) -> Column:
        inputs = dom.select(_TEXT_INPUTS, form)
        return F.struct(
            form["node_id"].alias("form_id"),
            dom.attr(form, "method").alias("method"),
            dom.attr(form, "action").alias("action"),
            is_likely_search_form(form).alias("likely"),
            is_get_form(form).alias("is_get"),
            F.size(inputs).alias("n_inputs"),
            F.get(inputs, 0)["node_id"].alias("input_id"),
        )

    return F.transform(dom.select("form"), facts)


def with_forms(pages: DataFrame) -> DataFrame:
    """Adds ``forms``: facts of every form of the page."""
    return pages.select("*", computed(_form_facts().alias("forms")))


def with_candidates(pages: DataFrame) -> DataFrame:
    """Adds ``inputs``: the scored input of every likely GET form with exactly one text input."""

    def candidate(f: Column) -> Column:
        e = dom.node(f["input_id"])
        scored = input_score(e, dom.node(f["form_id"]))
        return F.struct(
            f["input_id"].alias("input_id"),
            f["form_id"].alias("form_id"),
            f["action"].alias("action"),
            dom.attr(e, "name").alias("name"),
            scored["score"].alias("score"),
            scored["reasons"].alias("reasons"),
        )

    good = F.filter("forms", lambda f: f["likely"] & f["is_get"] & (f["n_inputs"] == 1))
    return with_forms(pages).select("*", computed(F.transform(good, candidate).alias("inputs")))


def with_best_input(pages: DataFrame) -> DataFrame:
    """Adds ``best``: a lone candidate wins unscored; else the best positive named one, first on ties."""
    usable = F.filter("inputs", lambda c: (c["score"] > 0) & ~is_blank(c["name"]))
    # A strictly better score replaces the leader, so the first one stays on ties.
    best = F.aggregate(
        usable,
        F.get(usable, 0),
        lambda top, c: F.when(c["score"] > top["score"], c).otherwise(top),
    )
    chosen = F.when(F.size("inputs") == 1, F.get("inputs", 0)).otherwise(best)
    return with_candidates(pages).select("*", computed(chosen.alias("best")))


def search_links(pages: DataFrame, *keys: str, site_url: str = "url") -> DataFrame:
    """(keys, search_url, reject_reason) per home page; a site without a template keeps its reason."""
    best = with_best_input(pages)
    no_get_form = F.size(F.filter("forms", lambda f: f["likely"] & f["is_get"])) == 0
    with_url = best.withColumn(
        "search_url", search_template(F.col(site_url), F.col("best.action"), F.col("best.name"))
    )
    reason = (
        F.when(F.col("text").isNull(), F.lit("no_page"))
        .when(no_get_form, F.lit("no_get_form"))
        .when(F.size("inputs") == 0, F.lit("no_single_input"))
        .when(F.col("best").isNull(), F.lit("no_named_input"))
        .when(F.col("best.name").isNull(), F.lit("no_name"))
        .when(F.col("search_url").isNull(), F.lit("bad_action"))
    )
    return with_url.select(*keys, computed(F.col("search_url"), reason.alias("reject_reason")))
