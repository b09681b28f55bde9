"""The rule set: directory pages, words, categories, probe queries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The default rule set.
DIRECTORY_URLS = [
    "https://fmhy.net/reading",
    "https://fmhy.net/video",
    "https://fmhy.net/gaming",
    "https://fmhy.net/downloading",
    "https://fmhy.net/linux-macos",
    "https://fmhy.net/mobile",
]
LINK_SKIP_WORDS = [
    "wiki", "github", "FOSS", "guide", "CSE", "reddit", "t.me", "mozilla", "greasyfork", "discord", "telegram",
    "vinegar", "guide", "launcher", "cli", "tui", "manager", "wine", "frontend", "invite", "mirrors",
]
LISTING_WORDS = ["category", "categories", "tag", "tags", "genre", "genres"]
CATEGORIES = [
    ("Books", "#ebooks, #public-domain, #pdf-search"),
    ("Movies", "#streaming-sites, #free-w-ads, #api-frontends, #single-server"),
    ("Anime", "#anime-streaming"),
    ("Games Download", "#download-games"),
    ("Games Repack", "#game-repacks"),
    ("Abandonware/ROM", "#abandonware-retro, #rom-sites, #nintendo-roms, #sony-roms"),
    ("Windows Software", "#software-sites"),
    ("Mac", "#software-sites-1, #mac-gaming"),
    ("Android", "#modded-apks, #untouched-apks"),
    ("iOS", "#ios-ipas"),
]
NONSENSE_QUERY = "asdfghjklqwerty12345"
PROBE_QUERIES = {
    "Books": ("sherlock", "harry potter"),
    "Movies": ("harry potter", "batman"),
    "Abandonware/ROM": ("mario", "zelda"),
}
DEFAULT_PROBES = ("the", "of")
GLOBE_CLASS = "i-twemoji-globe-with-meridians"

RULES_DDL = (
    "ScraperRules struct<MegathreadUrls:array<string>,MegathreadSkipKeywords:array<string>,"
    "SearchSkipKeywords:array<string>,Categories:array<struct<Name:string,Selector:string>>,"
    "CardFindingQueries:struct<InvalidQuery:string,ValidQueries:map<string,array<string>>>>"
)


@dataclass(frozen=True)
class Rules:
    """One rule set, held by the job that builds the plan."""

    directory_urls: list[str] = field(default_factory=lambda: list(DIRECTORY_URLS))
    link_skip_words: list[str] = field(default_factory=lambda: list(LINK_SKIP_WORDS))
    listing_words: list[str] = field(default_factory=lambda: list(LISTING_WORDS))
    categories: list[tuple[str, str]] = field(default_factory=lambda: list(CATEGORIES))
    nonsense_query: str = NONSENSE_QUERY
    probe_queries: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(PROBE_QUERIES))

    def probes(self, category: Column) -> Column:
        """The two probe queries of a category, else the defaults."""
        default = F.array(*[F.lit(q) for q in DEFAULT_PROBES])
        if not self.probe_queries:
            return default
        pairs = []
        for name, terms in self.probe_queries.items():
            pairs += [F.lit(name), F.array(*[F.lit(t) for t in terms])]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), category), default)


def rule_rows(documents: DataFrame, json: str = "json") -> DataFrame:
    """Rule documents (a JSON text column) parsed to typed columns."""
    return documents.withColumn("rules", F.from_json(json, RULES_DDL)["ScraperRules"]).drop(json)


def category_rows(rules: DataFrame, *keys: str) -> DataFrame:
    """One row per (category, element id) in written order."""
    categories = rules.select(*keys, F.posexplode("rules.Categories").alias("category_ord", "c"))
    ids = F.transform(F.split("c.Selector", ","), lambda s: F.regexp_replace(F.trim(s), "^#", ""))
    return categories.select(
        *keys,
        "category_ord",
        F.col("c.Name").alias("category"),
        F.posexplode(ids).alias("id_ord", "element_id"),
    )


def read_rules(spark: SparkSession, path: str) -> Rules:
    """The ``ScraperRules`` section of one JSON configuration file."""
    raw = spark.read.schema(RULES_DDL).json(path, multiLine=True)
    row = raw.select("ScraperRules.*").first()  # one configuration document
    return Rules(
        directory_urls=list(row["MegathreadUrls"]),
        link_skip_words=list(row["MegathreadSkipKeywords"]),
        listing_words=list(row["SearchSkipKeywords"]),
        categories=[(c["Name"], c["Selector"]) for c in row["Categories"]],
        nonsense_query=row["CardFindingQueries"]["InvalidQuery"],
        probe_queries={k: tuple(v) for k, v in row["CardFindingQueries"]["ValidQueries"].items()},
    )
