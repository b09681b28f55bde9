"""Registered queries: a name, a Spark query over the driver tables and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


# --- SQL fragments shared by the oracles ---------------------------------------

NAV = """nav as (
  select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) as href,
         unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) as text,
         unnest(range(len(regexp_extract_all(html, '<a href="[^"]*">')))) as ord
  from pages)"""

PARTS = """p as (
  select p_partkey, p_name, p_brand, p_type, p_size, p_partkey // 20 as site, p_partkey % 20 as j,
         p_partkey % 5 as kind
  from part)"""

LINKS = """l as (
  select site, sha256('https://s' || site || '.example.com') as id, 'Site ' || site as title,
         'https://s' || site || '.example.com' as url,
         ['Books', 'Movies', 'Games Download', 'Abandonware/ROM'][site % 4 + 1] as category,
         site % 3 = 0 as starred, 'https://s' || site || '.example.com/find?q={0}' as search_url,
         'div#results > .card' as selector, case when site % 13 <> 5 then site * 37 % 500 end as response_time
  from (select distinct p_partkey // 20 as site from part))"""


def title_case(x: str) -> str:
    """SQL of ``clean_title`` for text with plain spaces and line breaks."""
    return (
        rf"array_to_string(list_transform(string_split(trim(regexp_replace({x}, '\s+', ' ', 'g')), ' '), "
        r"lambda w: case when w = '' or regexp_matches(w, '\p{Lu}') or w[1] = 'ß' then w "
        r"else upper(w[1]) || lower(w[2:]) end), ' ')"
    )


def normal(x: str) -> str:
    """SQL of ``normalise_string`` for text with plain spaces and line breaks."""
    return title_case(rf"regexp_replace(lower({x}), '\p{{P}}', '', 'g')")
