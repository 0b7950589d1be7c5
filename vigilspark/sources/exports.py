"""Sinks: CSV and JSON exports, public identifiers, audit rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from vigilspark.functions import text, times

HISTORY_HEADER = {
    "Date": "date", "Type": "type", "Sent Amount": "amountIn", "Sent Asset": "assetIn", "Received Amount": "amountOut", "Received Asset": "assetOut", "From": "from", "To": "to", "Status": "status",
    "Fee Amount": "feeAmount", "Fee Currency": "feeCurrency", "Contract": "contractName", "TxID": "txID",
}


def history_rows(rows: DataFrame) -> DataFrame:
    """The thirteen columns of the history export."""
    return rows.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for name, c in HISTORY_HEADER.items()])


def csv_lines(rows: DataFrame) -> DataFrame:
    """(line): every cell in quotes, quotes doubled."""
    return rows.select(F.concat_ws(",", *[text.quoted(F.col(f"`{c}`")) for c in rows.columns]).alias("line"))


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of CSV files with a header, every cell in quotes."""
    rows.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in rows.columns]).write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)


FLAGGED_HEADER = "thor_address,flag_reason,l1_addresses,screened_at"


def flagged_lines(users: DataFrame, *keep: str) -> DataFrame:
    """(line, and columns to keep) of flagged users with `links` (array<struct<chain, l1_address>>): only the reason is quoted with care."""
    links = F.array_join(F.transform("links", lambda x: F.concat(x["chain"], F.lit(":"), x["l1_address"])), "|")
    plain = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    return users.select(*keep, F.concat_ws(",", plain(F.col("thor_address")), text.quoted(F.col("flag_reason")), plain(links), plain(F.coalesce(times.day(F.col("screened_at")), F.lit("")))).alias("line"))


def screening_rows(users: DataFrame, matches: str = "matches") -> DataFrame:
    """One row for each match of a screened user; blank match columns where there is none."""
    rows = users.select("*", F.explode_outer(matches).alias("__m")).drop(matches)
    fields = users.schema[matches].dataType.elementType.names
    return rows.select(*[c for c in rows.columns if c != "__m"], *[F.coalesce(F.col(f"__m.{f}").cast("string"), F.lit("")).alias(f"match_{f}") for f in fields])


def json_rows(rows: DataFrame) -> DataFrame:
    """(json): one object for each row, null fields kept."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("json"))


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def append_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


# The 32 symbols of public identifiers.
SYMBOLS = "ABCDEFGHJKLMNPQRSTUVWXYZ23456789"


def public_id(*parts: Column, size: int = 10, prefix: str = "") -> Column:
    """An identifier derived from a hash of its parts, so that a rerun names the same row alike."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    symbols = [F.substring(F.lit(SYMBOLS), (F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int") % 32 + 1).cast("int"), F.lit(1)) for i in range(size)]
    return F.concat(F.lit(prefix), *symbols)


AUDIT = "type string, status string, records_processed bigint, flags_found bigint, error string, duration bigint, created_at timestamp"


def audited(name: str, rows: DataFrame, write: Callable[[DataFrame], None], now: Callable[[], datetime], flagged: Column | None = None) -> DataFrame:
    """Writes `rows` and returns the audit row of the write; where it fails, an error row with the message.

    Rows and flags are counted as they pass to the sink, so the plan runs once and a sink that fails is seen.
    """
    spark, seen, started = rows.sparkSession, Observation(), now()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("records"), F.count_if(F.lit(False) if flagged is None else flagged).alias("flags"))
    status, records, flags, error = "success", None, None, None
    try:
        write(counted)
        records, flags = seen.get["records"], None if flagged is None else seen.get["flags"]
    except Exception as e:  # noqa: BLE001  (the audit row carries it)
        status, error = "error", str(e)[:500]
    ended = now()
    return spark.createDataFrame([(name, status, records, flags, error, int((ended - started).total_seconds() * 1000), ended)], AUDIT)


class StreamAudit(StreamingQueryListener):
    """Appends an audit row for each micro-batch of the session's queries that are named in `names`, and one for each that
    ends with an error. Counters are those that `live.with_progress` observes as `flags`."""

    def __init__(self, spark: SparkSession, folder: str, names: tuple[str, ...]) -> None:
        self.spark, self.folder, self.names = spark, folder, names
        self.held: dict[str, str] = {}

    def _put(self, *row: object) -> None:
        self.spark.createDataFrame([row], AUDIT).coalesce(1).write.mode("append").parquet(self.folder)

    def onQueryStarted(self, event) -> None:
        if event.name in self.names:
            self.held[str(event.id)] = event.name

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name in self.names:
            flags = next((m["flags"] for m in p.observedMetrics.values() if "flags" in m.asDict()), None)
            self._put(p.name, "success", p.numInputRows, flags, None, p.batchDuration, datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self.held.pop(str(event.id), None)
        if name and event.exception:
            self._put(name, "error", None, None, event.exception[:500], 0, datetime.now(UTC))
