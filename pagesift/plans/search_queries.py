"""Registered queries: extraction, ranking and search over rendered search pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.fuzzy import weighted_ratio
from pagesift.functions.text import normalise_string
from pagesift.operators import extract, ranking
from pagesift.operators.html import parse_pages
from pagesift.plans import render
from pagesift.plans.registry import LINKS, PARTS, normal, query, title_case
from pagesift.plans.search import search as run_search
from pagesift.sources.rules import LISTING_WORDS
from pagesift.sources.scratch import cut

# Usable cards: kind 3 shares its link with another card, kind 4 is an anchor itself.
_CARDS = rf"""{PARTS},
    first as (select site, first(p_name order by j) as first_name from p group by site),
    cards as (
      select site, j::int as card_ord, kind = 4 as is_anchor_card,
        case kind when 4 then '/a/' || p_partkey else '/p/' || replace(p_name, ' ', '-') || '-' || p_partkey end as href,
        case kind when 0 then ' ' || p_name || ' ' when 1 then 'Buy the ' || p_name
                  when 2 then p_type || '  ' || p_name || 'more' else p_name || ' ' || p_type end as raw_title,
        case when kind = 4 or p_size % 3 = 2 then null when p_size % 3 = 0 then '/img/' || p_partkey || '.png'
             else '/i/' || p_partkey || '.png' end as image,
        case when kind < 4 and p_size % 3 = 0 then p_type end as alt_text,
        case when kind < 4 then replace(p_name, ' ', '-') || '-' || p_partkey end as slug
      from p where kind <> 3)"""


def similarity_sql(pairs: str) -> str:
    """CTEs ``ratios(q, t, base)`` computing the weighted similarity of ``pairs(q, t)`` in SQL.

    The longest common subsequence runs on bit rows: one integer per character.
    """

    def lcs(a: str, b: str) -> str:
        mask = f"list_sum(list_transform(range(length({a})), lambda i: case when substr({a}, i + 1, 1) = c then 1::hugeint << i::int else 0::hugeint end))::hugeint"
        rows = f"list_transform(list_filter(string_split({b}, ''), lambda c: c <> ''), lambda c: {mask})"
        full = f"((1::hugeint << length({a})) - 1)"
        return (
            f"(length({a}) - bit_count(list_reduce(list_prepend({full}, {rows}), "
            f"lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full})))"
        )

    def ratio(a: str, b: str) -> str:
        low = f"case when length({a}) <= length({b}) then {a} else {b} end"
        high = f"case when length({a}) <= length({b}) then {b} else {a} end"
        return (
            f"(select case when length(lo) = 0 then 0 else round_even(200.0 * {lcs('lo', 'hi')} / (length(lo) + length(hi)), 0) end "
            f"from (select {low} as lo, {high} as hi))"
        )

    def partial(a: str, b: str) -> str:
        low = f"case when length({a}) <= length({b}) then {a} else {b} end"
        high = f"case when length({a}) <= length({b}) then {b} else {a} end"
        best = f"list_max(list_transform(range(length(hi) - length(lo) + 1), lambda k: {lcs('lo', 'substr(hi, k + 1, length(lo))')}))"
        return (
            f"(select case when length(lo) = 0 then 0 else round_even(100.0 * {best} / length(lo), 0) end "
            f"from (select {low} as lo, {high} as hi))"
        )

    words = "list_sort(list_filter(string_split({0}, ' '), lambda w: w <> ''))"
    return f"""tok as (select distinct q, t, {words.format('q')} as wq, {words.format('t')} as wt from {pairs}),
    st as (select q, t, array_to_string(wq, ' ') as sq, array_to_string(wt, ' ') as s_t,
        array_to_string(list_sort(list_distinct(list_filter(wq, lambda w: list_contains(wt, w)))), ' ') as t0,
        trim(array_to_string(list_sort(list_distinct(list_filter(wq, lambda w: list_contains(wt, w)))), ' ') || ' ' ||
          array_to_string(list_sort(list_distinct(list_filter(wq, lambda w: not list_contains(wt, w)))), ' ')) as t1,
        trim(array_to_string(list_sort(list_distinct(list_filter(wq, lambda w: list_contains(wt, w)))), ' ') || ' ' ||
          array_to_string(list_sort(list_distinct(list_filter(wt, lambda w: not list_contains(wq, w)))), ' ')) as t2,
        greatest(length(q), length(t)) / greatest(least(length(q), length(t)), 1)::double as stretch from tok),
    parts_ as (select *, {ratio('q', 't')} as plain,
        case when stretch >= 1.5 then {partial('q', 't')} end as part,
        case when stretch >= 1.5 then {partial('sq', 's_t')} else {ratio('sq', 's_t')} end as sorted_,
        case when stretch >= 1.5 then greatest({partial('t0', 't1')}, {partial('t0', 't2')}, {partial('t1', 't2')})
             else greatest({ratio('t0', 't1')}, {ratio('t0', 't2')}, {ratio('t1', 't2')}) end as set_ from st),
    ratios as (select q, t, case when q = '' or t = '' then 0 when stretch < 1.5
          then round_even(greatest(plain, .95 * sorted_, .95 * set_), 0)
          else round_even(greatest(plain, f * part, f * .95 * sorted_, f * .95 * set_), 0) end::int as base
        from (select *, case when stretch > 8 then .6 else .9 end as f from parts_)),
    scores as (select q, t, base, base
        + case when base > 95 and len(list_filter(string_split(q, ' '), lambda w: w <> ''))
            = len(list_distinct(list_filter(string_split(t, ' '), lambda w: w <> ''))) then 1 else 0 end
        - case when len(list_filter(string_split(q, ' '), lambda w: w <> '' and
            not list_contains(string_split(t, ' '), w))) > 0 then 1 else 0 end
        - case when length(t) < length(q) then 30 else 0 end as score from ratios)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_pages(render.site_search_pages(spark, sf_dir).withColumnRenamed("capture_id", "site"))


def _cards(spark: SparkSession, sf_dir: str, count_self_href: bool = True) -> DataFrame:
    ready = extract.with_cards(_pages(spark, sf_dir))
    return extract.with_unique_hrefs(extract.with_href_cards(ready, count_self_href))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(_pages(spark, sf_dir), LISTING_WORDS, "site", "site_url", site_url="site_url")


@query(
    "search_fanout",
    f"""with {PARTS}, {LINKS} select p.site as capture_id, l.search_url, {normal('first_name')} as query
        from (select site, first(p_name order by j) as first_name from p group by site) p join l using (site)""",
)
def search_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = extract.search_fanout(
        render.queries(spark, sf_dir), render.links(spark, sf_dir), render.search_pages(spark, sf_dir)
    )
    return wanted.select("capture_id", "search_url", "query")


@query(
    "select_cards",
    f"""with {PARTS} select site, j::int as card_ord, case kind when 4 then 'a' else 'div' end as tag from p""",
)
def select_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract.with_cards(_pages(spark, sf_dir))
    return pages.select("site", F.posexplode("cards").alias("card_ord", "card")).select("site", "card_ord", "card.tag")


_HREFS = f"""{_CARDS}, h as (
      select site, href, 1 as n_cards from cards
      union all select site, '/shared/' || (3 + j // 10 * 10), 1 from p where kind = 3
      union all select site, '/category/' || p_brand, 1 from p where kind < 4),
    counted as (select site, href, count(*) as n_cards from h group by all)"""


@query("href_card_count", f"with {_HREFS} select * from counted")
def href_card_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.href_card_count(_cards(spark, sf_dir), "site")


@query("unique_hrefs", f"with {_HREFS} select site, href from counted where n_cards = 1")
def unique_hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cards(spark, sf_dir).select("site", F.explode("unique_hrefs").alias("href"))


@query("first_anchor", f"with {_CARDS} select site, card_ord, href from cards where not is_anchor_card")
def first_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.card_candidates(_cards(spark, sf_dir), LISTING_WORDS, "site")
    return found.filter("not is_anchor_card").select("site", "card_ord", "href")


@query(
    "anchor_cards",
    f"""with {_CARDS} select true as counts_self, site, card_ord, href, raw_title from cards where is_anchor_card""",
)
def anchor_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both settings of ``count_self_href``: without it an anchor card gives nothing."""
    both = [
        extract.card_candidates(_cards(spark, sf_dir, own), LISTING_WORDS, "site")
        .filter("is_anchor_card")
        .select(F.lit(own).alias("counts_self"), "site", "card_ord", "href", "raw_title")
        for own in (True, False)
    ]
    return both[0].unionByName(both[1])


@query("card_title", f"with {_CARDS} select site, card_ord, raw_title from cards")
def card_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.card_candidates(_cards(spark, sf_dir), LISTING_WORDS, "site").select("site", "card_ord", "raw_title")


@query(
    "image_url",
    f"""with {_CARDS} select site, card_ord, 'https://s' || site || '.example.com' || image as image_url, alt_text
        from cards""",
)
def image_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("site", "card_ord", "image_url", "alt_text")


# --- scores ----------------------------------------------------------------------

_PAIRS = f"""{PARTS}, first as (select site, first(p_name order by j) as first_name from p group by site),
    pairs as (select p_partkey, {normal('first_name')} as q,
      {normal("case p_partkey % 3 when 0 then p_name when 1 then p_type || ' ' || p_name || '!' else p_name || ', ' || p_brand || ' (' || p_type || ') ' || p_name end")} as t
      from p join first using (site))"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A (query, title) pair per part, from a bare name to a text five times as long."""
    parts = render.parts(spark, sf_dir)
    first = render.sites(spark, sf_dir)
    kind = F.col("p_partkey") % 3
    title = (
        F.when(kind == 0, F.col("p_name"))
        .when(kind == 1, F.concat("p_type", F.lit(" "), "p_name", F.lit("!")))
        .otherwise(F.concat("p_name", F.lit(", "), "p_brand", F.lit(" ("), "p_type", F.lit(") "), "p_name"))
    )
    return parts.join(first, "site").select(
        "p_partkey", normalise_string(F.col("first_name")).alias("q"), normalise_string(title).alias("t")
    )


@query(
    "weighted_ratio",
    f"with {_PAIRS}, {similarity_sql('pairs')} select p_partkey, base as ratio from pairs join ratios using (q, t)",
)
def weighted_ratio_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("p_partkey", weighted_ratio(F.col("q"), F.col("t")).alias("ratio"))


@query(
    "ranking_score",
    f"with {_PAIRS}, {similarity_sql('pairs')} select p_partkey, q, t, score from pairs join scores using (q, t)",
)
def ranking_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.with_ranking_score(_pairs(spark, sf_dir), "q", "t", "score")


_SCORED = rf"""{_CARDS}, {LINKS},
    texts as (select cards.*, {normal('first_name')} as query, {normal('raw_title')} as nt,
        case when is_anchor_card then null else {normal("replace(slug, '-', ' ')")} end as ns
      from cards join first using (site)),
    pairs as (select query as q, nt as t from texts union select query, ns from texts where ns is not null),
    {similarity_sql('pairs')},
    scored as (select texts.*, case when b.score > a.score then b.score else a.score end as score,
        case when b.score > a.score then {title_case("replace(slug, '-', ' ')")} else {title_case('raw_title')} end as title
      from texts join scores a on a.q = query and a.t = nt left join scores b on b.q = query and b.t = ns),
    results as (select query, s.title, 'https://s' || site || '.example.com' || href as result_url, l.category,
        l.title as website_title, l.search_url, l.starred as website_starred, score,
        'https://s' || site || '.example.com' || image as image_url, alt_text, site, card_ord
      from scored s join l using (site))"""


@query("title_or_slug", f"with {_SCORED} select site, card_ord, title, score from scored")
def title_or_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = render.sites(spark, sf_dir).select("site", normalise_string(F.col("first_name")).alias("query"))
    scored = ranking.title_or_slug(_candidates(spark, sf_dir).join(first, "site"))
    return scored.select("site", "card_ord", "title", "score")


_COLUMNS = ", ".join(ranking.RESULT_COLUMNS)


def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All queries over all links and captured search pages."""
    links = ranking.dispatch_order(render.links(spark, sf_dir))
    return run_search(render.queries(spark, sf_dir), links, render.search_pages(spark, sf_dir))


@query("results", f"with {_SCORED} select query, {_COLUMNS} from results")
def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.result_rows(searched(spark, sf_dir), "query")


@query(
    "dispatch_order",
    f"with {LINKS} select id, url, response_time, row_number() over (order by response_time nulls last, id) - 1 as link_ord from l",
)
def dispatch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.dispatch_order(render.links(spark, sf_dir)).select("id", "url", "response_time", "link_ord")


@query(
    "rank_results",
    """select p_name as query, p_partkey, p_size % 40 - 20 as score, p_partkey % 50 as link_ord, p_partkey // 50 as card_ord,
         row_number() over (partition by p_name order by p_size % 40 - 20 desc, p_partkey % 50, p_partkey // 50) as rank
       from part""",
)
def rank_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = render.table(spark, sf_dir, "part").select(
        F.col("p_name").alias("query"),
        "p_partkey",
        (F.col("p_size") % 40 - 20).alias("score"),
        (F.col("p_partkey") % 50).alias("link_ord"),
        F.expr("p_partkey div 50").alias("card_ord"),
    )
    return ranking.rank_results(scored)


RANKED = f"""{_SCORED}, ordered as (select id, row_number() over (order by response_time nulls last, id) as link_ord, site from l),
    ranked as (select results.*, row_number() over (partition by query order by score desc, link_ord, card_ord) as rank
      from results join ordered using (site))"""


@query("search", f"with {RANKED} select query, rank, {_COLUMNS} from ranked")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranking.rank_results(cut(searched(spark, sf_dir)))
    return ranking.result_rows(ranked, "query", "rank")
