"""Registered queries: directory mining, search forms, card discovery and the whole discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.operators import cards, directory, forms
from pagesift.operators.html import parse_pages
from pagesift.plans import discover, render
from pagesift.plans import refresh as refreshing
from pagesift.plans.html_queries import nav_links
from pagesift.plans.registry import LINKS, NAV, query
from pagesift.sources import rules as rule_source
from pagesift.sources.rules import Rules
from pagesift.sources.scratch import cut, scratch_path

RULES = Rules(categories=render.DIRECTORY_CATEGORIES)

# --- directory pages -----------------------------------------------------------

# Every link of the directory pages, before the link rules.
_ENTRIES = """s as (select distinct p_partkey // 20 as site from part),
    e as (select site, site // 10 as page_ord, site % 3 as slot from s union all
          select site, site // 10, 3 from s where site % 4 = 0),
    c as (select * from (values (0, 0, 'Books'), (1, 1, 'Movies'), (2, 1, 'Movies'), (0, 2, 'Games Download'),
                                (3, 2, 'Games Download')) as t(slot, category_ord, category)),
    links as (
      select page_ord, category_ord, category, site, 'https://s' || site || '.example.com' as href,
             ' Site ' || site || e'\\n' as text, site % 3 = 0 as starred, site % 7 = 2 as has_globe
      from e join c using (slot)
      union all select page_ord, category_ord, category, site, 'https://mirror.example.com', '+5', false, false
      from e join c using (slot) where site % 7 = 1
      union all select page_ord, category_ord, category, site, ' ', 'x', site % 3 = 0, false
      from e join c using (slot) where site % 7 = 3
      union all select page_ord, category_ord, category, site, '/gui/GUIDE' || site, 'y', site % 3 = 0, false
      from e join c using (slot) where site % 7 = 3)"""

_KEPT = "not has_globe and text <> '+5' and href <> ' ' and text <> 'y'"


def _directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_pages(render.directory_pages(spark, sf_dir))


def _world(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Captures of all kinds of pages in one table, and the directory page list."""
    pages = render.directory_pages(spark, sf_dir)
    captures = (
        pages.drop("page_ord")
        .unionByName(render.site_homes(spark, sf_dir))
        .unionByName(render.probe_captures(spark, sf_dir))
    )
    groups = render.sites(spark, sf_dir).select(F.expr("site div 10").alias("page_ord")).distinct()
    listed = groups.select(render.fmt("https://dir.example.net/{g}", g=F.col("page_ord")).alias("url"), "page_ord")
    # Every page was captured before, when it said something else.
    older = captures.withColumns({
        "capture_id": -F.col("capture_id") - 1, "html": F.lit("<p>under construction"), "elapsed_ms": F.lit(999).cast("bigint")
    })
    return cut(captures.unionByName(older)), listed


@query(
    "rules_scan",
    """select p_partkey // 20 as doc, (p_partkey % 20)::int as category_ord, p_name as category, id_ord::int as id_ord,
         case id_ord when 0 then 'a' || p_partkey else 'b' || p_size end as element_id,
         'no' || (p_partkey // 20) as nonsense_query
       from part, (values (0), (1)) as t(id_ord)""",
)
def rules_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule document per 20 parts, written as JSON and read back typed."""
    grouped = (
        render.parts(spark, sf_dir)
        .groupBy("site")
        .agg(F.sort_array(F.collect_list(F.struct("j", "p_name", "p_partkey", "p_size"))).alias("p"))
    )
    categories = F.transform(
        "p",
        lambda c: F.struct(
            c["p_name"].alias("Name"),
            render.fmt("#a{k}, #b{z}", k=c["p_partkey"], z=c["p_size"]).alias("Selector"),
        ),
    )
    probes = F.struct(F.concat(F.lit("no"), F.col("site").cast("string")).alias("InvalidQuery"))
    document = F.struct(F.struct(categories.alias("Categories"), probes.alias("CardFindingQueries")).alias("ScraperRules"))
    parsed = rule_source.rule_rows(grouped.select(F.col("site").alias("doc"), F.to_json(document).alias("json")))
    rows = parsed.withColumn("nonsense_query", F.col("rules.CardFindingQueries.InvalidQuery"))
    return rule_source.category_rows(rows, "doc", "nonsense_query")


@query(
    "category_headers",
    """with g as (select distinct p_partkey // 200 as page_ord from part),
       c as (select * from (values (0, 'Books', 'c0'), (1, 'Movies', 'c1'), (1, 'Movies', 'c2'),
         (2, 'Games Download', 'none'), (2, 'Games Download', 'c3')) as t(category_ord, category, element_id))
       select page_ord, category_ord::int as category_ord, category, element_id from g cross join c""",
)
def category_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.category_headers(_directory(spark, sf_dir), RULES, "page_ord").drop("header_id")


@query(
    "header_list_links",
    f"""with {_ENTRIES} select page_ord, category_ord::int as category_ord, category, href, text, starred, has_globe
        from links""",
)
def header_list_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.header_list_links(_directory(spark, sf_dir), RULES, "page_ord").drop("header_id", "node_id")


@query(
    "link_has_globe",
    f"with {_ENTRIES} select page_ord, href, has_globe, count(*) as n from links group by all",
)
def link_has_globe(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = directory.header_list_links(_directory(spark, sf_dir), RULES, "page_ord")
    return links.groupBy("page_ord", "href", "has_globe").agg(F.count("*").alias("n"))


@query("starred", f"with {_ENTRIES} select page_ord, starred, count(*) as n from links group by all")
def starred(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = directory.header_list_links(_directory(spark, sf_dir), RULES, "page_ord")
    return links.groupBy("page_ord", "starred").agg(F.count("*").alias("n"))


@query(
    "website_links",
    f"""with {_ENTRIES} select page_ord, category, trim(text, e' \\n') as title, href as url, starred from links
        where {_KEPT}""",
)
def website_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = directory.website_links(_directory(spark, sf_dir), RULES, "page_ord")
    return links.select("page_ord", "category", "title", "url", "starred")


@query(
    "directory_union",
    f"""with {_ENTRIES} select page_ord, category_ord::int as category_ord, category, href as url, starred from links
        where {_KEPT}""",
)
def directory_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, pages = _world(spark, sf_dir)
    links = discover.directory_union(captures, pages, RULES)
    return links.select("page_ord", "category_ord", "category", "url", "starred")


@query(
    "first_by_url",
    f"""with {NAV} select href as url, text as title, page_id as page_ord, ord as node_ord from nav
        qualify row_number() over (partition by href order by page_id, ord) = 1""",
)
def first_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = nav_links(spark, sf_dir).select(
        F.col("href").alias("url"),
        F.col("text").alias("title"),
        F.lit("nav").alias("category"),
        F.lit(False).alias("starred"),
        F.col("page_id").alias("page_ord"),
        F.lit(0).alias("category_ord"),
        F.lit(0).alias("header_id"),
        F.col("ord").alias("node_id"),
    )
    first = directory.first_by_url(links)
    return first.select("url", "title", "page_ord", F.col("node_id").alias("node_ord"))


# --- search forms --------------------------------------------------------------

# Forms of the home page variants: variant, form order, likely, GET, text inputs, score, reasons.
_FORMS = """f(v, form_ord, likely, is_get, n_inputs, score, reasons) as (values
    (0, 0, true, true, 1, 360, '+100 (Base:type=''search''), +75 (in role=''search''), +50 (in <header>), +35 (attr name), +50 (adj. btn match), +50 (Certainty Bonus)'),
    (0, 1, false, true, 1, null, null),
    (1, 0, true, true, 1, 115, '+10 (Base:type=''text''), +50 (in <header>), +35 (attr name), +20 (placeholder)'),
    (1, 1, true, true, 1, -65, '+100 (Base:type=''search''), +35 (attr name), -200 (in <footer>)'),
    (2, 0, false, true, 1, null, null),
    (3, 0, true, false, 1, null, null),
    (4, 0, true, true, 2, null, null),
    (5, 0, true, true, 1, 45, '+10 (Base:type=''text''), +35 (attr id)'),
    (5, 1, true, true, 1, 100, '+100 (Base:type=''search'')'),
    (6, 0, true, true, 1, 100, '+100 (Base:type=''search'')'),
    (7, 0, true, true, 1, 255, '+10 (Base:type=''text''), +40 (in <nav>), +35 (attr id), +35 (attr name), +35 (attr aria-label), +50 (adj. btn match), +50 (Certainty Bonus)'),
    (7, 1, true, true, 1, 35, '+100 (Base:type=''search''), +35 (attr name), -100 (in sidebar)'),
    (8, 0, true, true, 1, 10, '+10 (Base:type=''text'')'),
    (10, 0, true, true, 1, 70, '+100 (Base:type=''search''), +35 (attr name), +35 (attr data-testid), -100 (in sidebar)'),
    (10, 1, true, true, 1, 95, '+10 (Base:type=''text''), +35 (attr name), +50 (adj. btn match)'),
    (11, 0, true, true, 1, -190, '+10 (Base:type=''text''), -200 (in <footer>)'))"""

# Chosen input and template path of the variants that have one.
_BEST = """b(v, score, path) as (values
    (0, 360, '/find?q={0}'), (1, 115, '/shop/find?s={0}'), (6, 100, null), (7, 255, '/find?search%20box={0}#top'),
    (8, 10, '?'), (10, 95, '/find?q={0}'), (11, -190, '/find?f'))"""


def _homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_pages(render.customer_homes(spark, sf_dir))


def _form_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = forms.with_forms(_homes(spark, sf_dir))
    return pages.select("capture_id", F.posexplode("forms").alias("form_ord", "form"))


@query(
    "likely_search_form",
    f"""with {_FORMS} select c_custkey as capture_id, form_ord, likely from customer join f on c_custkey % 12 = v""",
)
def likely_search_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _form_rows(spark, sf_dir).select("capture_id", "form_ord", "form.likely")


@query(
    "get_forms",
    f"""with {_FORMS} select c_custkey as capture_id, form_ord from customer join f on c_custkey % 12 = v
        where likely and is_get""",
)
def get_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _form_rows(spark, sf_dir).filter("form.likely and form.is_get").select("capture_id", "form_ord")


@query(
    "single_input_forms",
    f"""with {_FORMS} select c_custkey as capture_id, form_ord, n_inputs from customer join f on c_custkey % 12 = v""",
)
def single_input_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _form_rows(spark, sf_dir).select("capture_id", "form_ord", "form.n_inputs")


@query(
    "input_score",
    f"""with {_FORMS} select c_custkey as capture_id, score, reasons from customer join f on c_custkey % 12 = v
        where score is not null""",
)
def input_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = forms.with_candidates(_homes(spark, sf_dir)).select("capture_id", F.inline("inputs"))
    return scored.select("capture_id", "score", F.array_join("reasons", ", ").alias("reasons"))


@query(
    "best_input",
    f"""with {_BEST} select c_custkey as capture_id, score from customer join b on c_custkey % 12 = v""",
)
def best_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = forms.with_best_input(_homes(spark, sf_dir)).filter("best is not null")
    return best.select("capture_id", "best.score")


_TEMPLATE = """case when v = 8 then 'https://find.example.org/?k' || c_custkey % 10 || '={0}'
      when v = 11 then 'https://c' || c_custkey || '.example.com/find?f' || c_custkey % 10 || '={0}'
      else 'https://c' || c_custkey || '.example.com' || path end"""


@query(
    "search_template",
    f"""with {_BEST} select c_custkey as capture_id, {_TEMPLATE} as search_url
        from customer join b on c_custkey % 12 = v where v <> 6""",
)
def search_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forms.search_links(_homes(spark, sf_dir), "capture_id")
    return found.filter("search_url is not null").drop("reject_reason")


@query(
    "search_links",
    f"""with {_BEST} select c_custkey as capture_id, c_name as title, c_mktsegment as category,
          {_TEMPLATE} as search_url
        from customer join b on c_custkey % 12 = v where v <> 6""",
)
def search_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = render.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("capture_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("category")
    )
    found = forms.search_links(_homes(spark, sf_dir), "capture_id").filter("search_url is not null")
    return sites.join(found.drop("reject_reason"), "capture_id")


@query(
    "form_rejects",
    """select c_custkey as capture_id, case c_custkey % 12 when 2 then 'no_get_form' when 3 then 'no_get_form'
         when 4 then 'no_single_input' when 5 then 'no_named_input' when 6 then 'no_name' else 'no_get_form' end
         as reject_reason
       from customer where c_custkey % 12 in (2, 3, 4, 5, 6, 9)""",
)
def form_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forms.search_links(_homes(spark, sf_dir), "capture_id")
    return found.filter("reject_reason is not null").drop("search_url")


# --- card discovery ------------------------------------------------------------

_PROBED = """p as (select p_partkey // 20 as site, 1 + p_partkey % 2 as probe_no, p_partkey % 20 as j, p_name, p_type,
      p_size % 3 as c, p_partkey // 20 % 11 as odd from part),
    pg as (select distinct site, probe_no, odd from p)"""


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_pages(render.probe_pages(spark, sf_dir))


@query(
    "probe_queries",
    f"""with {LINKS}, q(category, probe_no, probe_query) as (values
          ('Books', 1, 'sherlock'), ('Books', 2, 'harry potter'), ('Movies', 1, 'harry potter'), ('Movies', 2, 'batman'),
          ('Abandonware/ROM', 1, 'mario'), ('Abandonware/ROM', 2, 'zelda'), ('Games Download', 1, 'the'),
          ('Games Download', 2, 'of'))
        select url, probe_no, probe_query from l join q using (category)
        union all select url, 0, 'asdfghjklqwerty12345' from l""",
)
def probe_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.probe_queries(render.links(spark, sf_dir), Rules()).select("url", "probe_no", "probe_query")


@query(
    "no_result_blacklist",
    """select p_partkey // 20 as site, parent_path, element from (select distinct p_partkey // 20 * 20 as p_partkey from part) part, (values ('head', 'title'), ('body', 'nav'),
         ('body > nav', 'ul'), ('body > nav > ul', 'li'), ('body > nav > ul > li', 'a'), ('body', 'p.none'),
         ('body', 'footer'), ('body > footer', 'p'), ('body > footer > p', 'a')) as t(parent_path, element)""",
)
def no_result_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = parse_pages(render.probe_pages(spark, sf_dir).filter("probe_no = 0"))
    return cards.no_result_blacklist(empty, "site")


@query(
    "diff_candidates",
    f"""with {_PROBED}, b as (
      select site, probe_no, 'body' as parent_path, 'div.pages' as element, 1 as n from pg
      union all select site, probe_no, 'body > div', 'a', 3 from pg
      union all select site, probe_no, 'body', case when odd = 6 and probe_no = 2 then 'div.other' else 'div.grid' end, 1
      from pg where odd <> 5
      union all select site, probe_no, 'body > div', 'div.c' || c || '.card', count(*) from p where odd <> 5 group by all
      union all select site, probe_no, 'body > div > div', unnest(['a', 'h2', 'p']), n
      from (select site, probe_no, count(*) as n from p where odd <> 5 group by all)
      union all select site, probe_no, 'body > div > div > a', 'img', count(*) from p where odd <> 5 group by all)
    select site, probe_no::int as probe_no, parent_path, element, n from b""",
)
def diff_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = _probes(spark, sf_dir)
    found = cards.diff_candidates(probes, "site").groupBy("site", "probe_no", "element_key")
    told = cards.spelled(found.agg(F.min("node_id").alias("node_id"), F.count("*").alias("n")), probes, "site")
    return told.select("site", "probe_no", "parent_path", "element", "n")


@query(
    "sibling_patterns",
    f"""with {_PROBED}, b as (
      select site, probe_no, '' as signature, 3 as size, 1 as groups from pg
      union all select site, probe_no, 'AAA', 1, 1 from pg
      union all select site, probe_no, string_agg('DIV', ''), 1, 1 from p where odd <> 5 group by all
      union all select site, probe_no, 'AH2P', count(*), 1 from p where odd <> 5 group by all
      union all select site, probe_no, 'IMG', 1, count(*) from p where odd <> 5 group by all
      union all select site, probe_no, '', 2, count(*) from p where odd <> 5 group by all
      union all select site, probe_no, '', 1, count(*) from p where odd <> 5 group by all)
    select site, probe_no::int as probe_no, signature, size::bigint as size, groups::bigint as groups from b""",
)
def sibling_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = _probes(spark, sf_dir)
    patterns = cards.sibling_patterns(cards.diff_candidates(probes, "site"), "site")
    sizes = patterns.groupBy("site", "probe_no", "signature_key", F.col("count").alias("size"))
    told = cards.spelled(sizes.agg(F.min("first_id").alias("node_id"), F.count("*").alias("groups")), probes, "site")
    return told.select("site", "probe_no", "signature", "size", "groups")


_PATTERNS = f"""with {_PROBED}, b as (
      select site, probe_no, 'div.pages' as parent, 3 as count from pg
      union all select site, probe_no, case when odd = 6 and probe_no = 2 then 'div.other' else 'div#results' end, count(*)
      from p where odd <> 5 group by all, odd
      union all select site, probe_no, 'div.c' || c || '.card', 1 from p where odd <> 5)"""


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.sibling_patterns(cards.diff_candidates(_probes(spark, sf_dir), "site"), "site")


@query(
    "pattern_filter",
    f"{_PATTERNS} select site, probe_no::int as probe_no, count(*) as n from b group by all".replace(
        "group by all, odd", "group by site, probe_no, odd"
    ),
)
def pattern_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = cards.card_patterns(_patterns(spark, sf_dir))
    return kept.groupBy("site", "probe_no").agg(F.count("*").alias("n"))


@query(
    "pattern_rows",
    f"{_PATTERNS} select site, probe_no::int as probe_no, parent, count::bigint as count from b".replace(
        "group by all, odd", "group by site, probe_no, odd"
    ),
)
def pattern_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.pattern_rows(_patterns(spark, sf_dir), "site").drop("element_ids")


@query(
    "best_pattern",
    f"""with {_PROBED}
    select site, probe_no::int as probe_no,
           case when odd = 5 then null when odd = 6 and probe_no = 2 then 'div.other' else 'div#results' end as parent,
           case when odd <> 5 then count(*) end as count,
           case when odd <> 5 then count(*) * 10 + 15 + min_by(length(p_name || p_type), j) // 5 end as score
    from p group by site, probe_no, odd""",
)
def best_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = cards.best_patterns(_patterns(spark, sf_dir), "site")
    return best.select("site", "probe_no", "parent", "count", "score")


_SELECTOR = """'div#results > div' || case when count(distinct p_size % 3) = 1 then '.c' || min(p_size % 3) else '' end
      || '.card'"""


@query(
    "card_selector",
    f"""select p_partkey // 20 as site,
          case when p_partkey // 20 % 11 not in (5, 6) then {_SELECTOR} end as selector,
          case p_partkey // 20 % 11 when 5 then 'only_pagination' when 6 then 'inconsistent_patterns' end as reject_reason
        from part group by 1, p_partkey // 20 % 11""",
)
def card_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.find_card_selectors(_probes(spark, sf_dir), "site")


@query(
    "mean_response_ms",
    """select site, ((site * 7) % 50 + (site * 7 + 3) % 50 + (site * 7 + 6) % 50 + 30) // 3 as response_time
       from (select distinct p_partkey // 20 as site from part)""",
)
def mean_response_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.mean_response_ms(render.probe_pages(spark, sf_dir), "site")


# --- the whole discovery ---------------------------------------------------------

_OUTCOME = f"""d as (
      select site, case when site % 3 = 0 then 'Books' else 'Movies' end as category,
        case site % 12 when 0 then '/find?q={{0}}' when 1 then '/find?s={{0}}' when 7 then '/find?search%20box={{0}}#top'
          when 8 then '' when 10 then '/find?q={{0}}' when 11 then '/find?f' || site % 10 || '={{0}}' end as path,
        case when site % 12 in (2, 3, 9) then 'no_get_form' when site % 12 = 4 then 'no_single_input'
          when site % 12 = 5 then 'no_named_input' when site % 12 = 6 then 'no_name' when site % 12 = 8 then 'no_capture'
          when site % 11 = 5 then 'only_pagination' when site % 11 = 6 then 'inconsistent_patterns' end as reason,
        selector
      from (select p_partkey // 20 as site, {_SELECTOR} as selector from part group by 1) where site % 7 <> 2)"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, pages = _world(spark, sf_dir)
    return discover.discovery_report(captures, pages, RULES)


@query(
    "discover_links",
    f"""with {_OUTCOME}
    select sha256('https://s' || site || '.example.com') as id, 'Site ' || site as title,
      'https://s' || site || '.example.com' as url, category, site % 3 = 0 as starred,
      'https://s' || site || '.example.com' || path as search_url, selector,
      ((site * 7) % 50 + (site * 7 + 3) % 50 + (site * 7 + 6) % 50 + 30) // 3 as response_time
    from d where reason is null""",
)
def discover_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.discovered_links(_report(spark, sf_dir))


@query(
    "discovery_funnel",
    f"""with {_OUTCOME} select count(*) as website_links, count(path) as search_links,
        count(*) filter (reason is null) as links from d""",
)
def discovery_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.discovery_funnel(_report(spark, sf_dir))


@query(
    "site_errors",
    f"""with {_OUTCOME} select 'https://s' || site || '.example.com' as url,
        case when path is null then 'form' else 'cards' end as reject_stage, reason as reject_reason
        from d where reason is not null""",
)
def site_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.site_errors(_report(spark, sf_dir))


@query(
    "discover_refresh",
    f"""with {_OUTCOME} select 'https://s' || site || '.example.com' as url, case when reason is null then selector end as selector,
        reason as reject_reason,
        cast(case when site % 10 <> 3 then 0 when path is null or path = '' then 1 else 4 end as bigint) as n_parsed
      from d""",
)
def discover_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovery while the homes of every tenth site are under construction, then again when they are finished.

    The second run parses the homes and probes of these sites only; everything was fetched again in between.
    """
    captures, pages = _world(spark, sf_dir)
    site = F.regexp_extract("url", r"^https://s([0-9]+)\.example\.com$", 1).try_cast("bigint")
    late = F.coalesce(site % 10 == 3, F.lit(False))
    state = refreshing.DiscoveryState(spark, scratch_path(spark, "discovery"))
    refreshing.refresh(captures.filter(~late | (F.col("capture_id") < 0)), pages, RULES, state)
    again = captures.filter("capture_id >= 0").withColumn("capture_id", F.col("capture_id") + 10_000_000_000)
    second = refreshing.refresh(captures.unionByName(again), pages, RULES, state)
    parsed = second.parsed.groupBy("url").agg(F.count("*").alias("n_parsed"))
    sites = second.report.select("url", "selector", "reject_reason")
    return sites.join(parsed, "url", "full").fillna(0, ["n_parsed"])
