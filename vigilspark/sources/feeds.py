"""Feed readers: sanctions XML, free text, event logs, and paged or cursor-driven endpoints.

Endpoints are read by a Python data source that yields the pages it is given a fetcher for; without a network the
fetcher reads files, one page each.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vigilspark.functions import codecs, nested, text
from vigilspark.operators import dims
from vigilspark.sources import storage

# One party of a sanctions document.
PARTY = (
    "Profile array<struct<_ID:string,"
    "Identity:array<struct<_ID:string,Alias:array<struct<DocumentedName:array<struct<DocumentedNamePart:array<struct<NamePartValue:array<struct<_VALUE:string>>>>>>>>>>,"
    "Feature:array<struct<_FeatureTypeID:string,FeatureVersion:array<struct<VersionDetail:array<struct<_VALUE:string>>>>,IdentityReference:array<struct<_IdentityID:string>>>>>>"
)


def read_sanctions(spark: SparkSession, path: str) -> DataFrame:
    """Parties of a sanctions XML document, one row each; files are split by party."""
    return spark.read.format("xml").option("rowTag", "DistinctParty").schema(PARTY).load(path)


def parse_parties(texts: DataFrame, column: str = "xml") -> DataFrame:
    """Parties from a column of XML texts, one party each, with the table's other columns; a text that is no party gives nulls."""
    return texts.withColumn("party", F.from_xml(F.col(column), PARTY, {"mode": "PERMISSIVE"})).select("*", "party.*").drop("party")


def party_texts(parties: DataFrame) -> DataFrame:
    """(xml) of parties, without indents: the inverse of parse_parties."""
    return parties.select(F.to_xml(F.struct("Profile"), {"rowTag": "DistinctParty", "declaration": "", "indent": ""}).alias("xml"))


def sanctioned_addresses(parties: DataFrame, feature_chains: dict[str, str] | None = None, source: str = "OFAC", reason: str = "OFAC SDN List", unknown: str = "Unknown OFAC Entity") -> DataFrame:
    """(address, chain, source, entity_name, reason) of parties' digital-currency features.

    Names are joined by identity, so that a feature may stand before the name it refers to; the last name of an
    identity counts, and an identity without a name has the default.
    """
    # stored as they are parsed: names and features read the same profiles, so that a text is parsed once; the outer
    # explode has no filter that would parse it again
    profile = storage.stored(parties.select(F.explode_outer("Profile").alias("p")).select("p._ID", "p.Identity", "p.Feature"), "profiles")
    identity = profile.select(F.col("_ID").alias("profile_id"), F.posexplode("Identity").alias("i_no", "i"))
    parts = lambda d: F.flatten(F.transform(d["DocumentedNamePart"], lambda x: F.transform(x["NamePartValue"], lambda v: v["_VALUE"])))
    names = identity.select(F.coalesce("i._ID", "profile_id").alias("identity_id"), "i_no", F.posexplode("i.Alias").alias("a_no", "a"))
    names = names.select("identity_id", "i_no", "a_no", F.posexplode("a.DocumentedName").alias("d_no", "d"))
    names = names.select("identity_id", F.struct("i_no", "a_no", "d_no").alias("at"), F.array_join(F.filter(parts(F.col("d")), lambda x: F.trim(x) != ""), " ").alias("name")).filter("name <> ''")
    names = names.groupBy("identity_id").agg(F.max_by("name", "at").alias("name"))
    chains = F.create_map(*[F.lit(x) for kv in (feature_chains or dims.FEATURE_CHAINS).items() for x in kv])
    features = profile.select(F.explode("Feature").alias("f")).select(nested.lookup(chains, F.col("f._FeatureTypeID")).alias("chain"), nested.first(F.col("f.IdentityReference"))["_IdentityID"].alias("identity_id"), F.explode("f.FeatureVersion").alias("v")).filter("chain is not null")
    found = features.select("chain", "identity_id", F.explode("v.VersionDetail").alias("d")).select("chain", "identity_id", F.trim("d._VALUE").alias("address")).filter("address <> ''")
    return found.join(names, "identity_id", "left").select(text.normalize_address(F.col("address"), F.col("chain"), text.LOWER_SANCTIONS).alias("address"), "chain", F.lit(source).alias("source"), F.coalesce("name", F.lit(unknown)).alias("entity_name"), F.lit(reason).alias("reason"))


def text_addresses(texts: DataFrame, column: str = "value", source: str = "EU", entity: str = "EU Sanctioned Entity", least: int = 100, patterns: dict[str, str] = text.ADDRESS_PATTERNS) -> DataFrame:
    """Addresses in free text; texts shorter than `least` are left out; each address once."""
    rows = texts.filter(F.length(column) >= least).select(F.explode(text.addresses_in(F.col(column), patterns)).alias("a"))
    rows = rows.select(text.normalize_address(F.col("a.address"), F.col("a.chain"), text.LOWER_FEEDS).alias("address"), F.col("a.chain").alias("chain"))
    order = F.create_map(*[F.lit(x) for i, c in enumerate(patterns) for x in (c, i)])
    return rows.groupBy("address").agg(F.min_by("chain", F.element_at(order, F.col("chain"))).alias("chain")).select("address", "chain", F.lit(source).alias("source"), F.lit(entity).alias("entity_name"))


def frozen_from_logs(logs: DataFrame) -> DataFrame:
    """(address, chain) of event logs that name an address in their first word."""
    return logs.select(nested.event_address(F.col("data")).alias("address"), F.lit("ETH").alias("chain")).filter("address is not null").distinct()


def frozen_from_events(events: DataFrame) -> DataFrame:
    """(address, chain) of events whose address is hexadecimal or already Base58."""
    raw = events.select(F.coalesce("result._user", "result.user").alias("raw")).filter("raw is not null").distinct()
    return raw.select(codecs.to_tron_address("raw").alias("address"), F.lit("TRX").alias("chain")).distinct()


def with_retry(fetch: Callable[[], str], tries: int = 3, first_wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Calls again after 1, 2, 4, ... times the first wait; the last error is raised."""
    for i in range(tries):
        try:
            return fetch()
        except OSError:
            if i == tries - 1:
                raise
            sleep(first_wait * 2**i)
    raise ValueError("tries must be positive")


class _Address(InputPartition):
    def __init__(self, number: int, name: str) -> None:
        self.number, self.name = number, name


class PagedReader(DataSourceReader):
    """Reads the pages of each address in turn; addresses are read in parallel.

    A page is JSON with `items` and, where there is a next page, `next`. A short page ends an address. An address that can't
    be read, or has pages beyond the limit, fails the job; with `partial` it ends with a row that says so in `error`.
    See `endpoints` for a stream that resumes.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.addresses = [a for a in options.get("addresses", "").split(",") if a]
        self.size, self.limit = int(options.get("pagesize", "50")), int(options.get("maxpages", "100"))
        self.partial = options.get("partial", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [_Address(i, a) for i, a in enumerate(self.addresses)]

    def read(self, partition: _Address) -> Iterator[tuple]:
        cursor: str | None = "0"
        for page in range(self.limit):
            try:
                with open(f"{self.root}/{partition.name}/{cursor}.json", encoding="utf-8") as f:
                    got = json.loads(with_retry(f.read))
            except OSError as e:
                if not self.partial:
                    raise
                yield partition.name, page, None, None, str(e)
                return
            for i, item in enumerate(got["items"]):
                yield partition.name, page, i, json.dumps(item), None
            cursor = got.get("next")
            if cursor is None or len(got["items"]) < self.size:
                return
        message = f"{partition.name} has pages beyond the limit of {self.limit}"
        if not self.partial:
            raise ValueError(message)
        yield partition.name, self.limit, None, None, message


class PagedSource(DataSource):
    """spark.read.format("paged"): rows (address, page, pos, item, error) of cursor-paged endpoints."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "address string, page int, pos int, item string, error string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def read_pages(spark: SparkSession, path: str, addresses: list[str], schema: str, **options: str) -> DataFrame:
    """Items of paged endpoints, parsed: (address, page, pos, error, and the item's fields)."""
    spark.dataSource.register(PagedSource)
    rows = spark.read.format("paged").option("path", path).option("addresses", ",".join(addresses)).options(**options).load()
    return rows.select("address", "page", "pos", "error", F.from_json("item", schema).alias("i")).select("address", "page", "pos", "error", "i.*")


def read_actions(spark: SparkSession, path: str, schema) -> DataFrame:
    """Nested action records from JSON lines, with an explicit schema (no inference pass)."""
    return spark.read.schema(schema).json(path)


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(polygon, rings) of a GeoJSON document; each part of a multi-polygon is a polygon of its own."""
    schema = "features array<struct<geometry:struct<type:string,coordinates:string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("features").alias("feature", "f"))
    multi = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    single = F.array(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"))
    parts = F.when(F.col("f.geometry.type") == "MultiPolygon", multi).otherwise(single)
    return rows.select("feature", F.posexplode(parts).alias("part", "rings")).select(F.concat_ws(".", "feature", "part").alias("polygon"), "rings")


def read_database(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 16, **options: str) -> DataFrame:
    """A table over JDBC; with a numeric key it is read in `parts` ranges at once."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key:
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()
