"""Paged endpoints as a stream that resumes where it stopped.

`spark.readStream.format("endpoint")` reads pages of many addresses in rounds, one micro-batch each. In a round each task
takes the addresses of its block from the cursors that the round before left in the progress folder, fetches a number of
pages, and leaves the new cursors there. An offset is the number of a round: a round that is repeated starts from the same
cursors, and a later run polls the last pages again and gives only what is new. What can't be read is a row with its
status and message; so is an address that is given up at its page limit.

A page is JSON with `items` and, where there is a next page, `next`. The progress folder must be one that the driver and
all executors share; it is read and written with pyarrow's file systems (file://, hdfs://, s3://, ...).
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "address string, round int, page int, pos int, status int, item string, error string"
#: Statuses of rows without an item that no server sends: no answer, a page that is no page, an address at its page limit.
NO_ANSWER, BAD_PAGE, CAPPED = 0, -1, -2

#: The most pages of an address in a round that grows.
MOST_PAGES = 10_000

Fetch = Callable[[str, str], tuple[int, str]]


class FolderFetch:
    """Pages from text files: <root>/address=<address>/cursor=<cursor>/*, as a partitioned text write lays them out."""

    def __init__(self, root: str) -> None:
        self.root = root

    def __call__(self, address: str, cursor: str) -> tuple[int, str]:
        store, path = fs.FileSystem.from_uri(self.root)
        folder = f"{path}/address={urllib.parse.quote(address)}/cursor={urllib.parse.quote(cursor)}"
        files = [x for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.is_file and x.base_name[0] not in "._"]
        if not files:
            return 404, f"no page {folder}"
        body = ""
        for x in sorted(files, key=lambda x: x.path):
            with store.open_input_stream(x.path) as f:
                body += f.read().decode()
        return 200, body


class HttpFetch:
    """Pages over HTTP: `url` holds {address} and {cursor}."""

    def __init__(self, url: str, headers: dict[str, str] | None = None, timeout: float = 30.0) -> None:
        self.url, self.headers, self.timeout = url, headers or {}, timeout

    def __call__(self, address: str, cursor: str) -> tuple[int, str]:
        asked = self.url.format(address=urllib.parse.quote(address, safe=""), cursor=urllib.parse.quote(cursor, safe=""))
        try:
            with urllib.request.urlopen(urllib.request.Request(asked, headers=self.headers), timeout=self.timeout) as got:
                return got.status, got.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode(errors="replace")


class AnyOf:
    """The first good answer of several endpoints that serve the same pages, asked in order; else the last answer."""

    def __init__(self, *fetches: Fetch) -> None:
        self.fetches = fetches

    def __call__(self, address: str, cursor: str) -> tuple[int, str]:
        status, body = NO_ANSWER, "no endpoint"
        for fetch in self.fetches:
            try:
                status, body = fetch(address, cursor)
            except OSError as e:
                status, body = NO_ANSWER, str(e)
            if 200 <= status < 300:
                break
        return status, body


def patient(fetch: Fetch, address: str, cursor: str, tries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> tuple[int, str]:
    """The first good answer; after a refusal for too many requests or no answer at all the next try waits twice as long,
    after another bad status it comes at once. Of bad answers the last is given."""
    status, body = NO_ANSWER, "never asked"
    for n in range(tries):
        try:
            status, body = fetch(address, cursor)
        except OSError as e:
            status, body = NO_ANSWER, str(e)
        if 200 <= status < 300:
            break
        if status in (429, NO_ANSWER) and n < tries - 1:
            sleep(wait * 2**n)
    return status, body


class _Block(InputPartition):
    def __init__(self, number: int, round_: int) -> None:
        self.number, self.round = number, round_


class EndpointReader(DataSourceStreamReader):
    """Options: addresses (JSON array), progress, pages (a round), growth (an address that a round left open gets so many
    times the pages in the next one, until it ends; at most MOST_PAGES or `pages`), maxpages (of an address, 0: none), oncap (report or
    raise), tasks, start (the first cursor), tries, wait, and folder or url (with headers as JSON); several folders or urls
    are a JSON array and are asked in order."""

    def __init__(self, options: dict[str, str]) -> None:
        self.addresses: list[str] = json.loads(options["addresses"])
        self.store, self.progress = fs.FileSystem.from_uri(options["progress"])
        self.pages, self.most = int(options.get("pages", "10")), int(options.get("maxpages", "0"))
        self.growth = int(options.get("growth", "1"))
        self.raises = options.get("oncap", "report") == "raise"
        self.start = options.get("start", "0")
        self.tries, self.wait = int(options.get("tries", "3")), float(options.get("wait", "1.0"))
        self.blocks = max(1, min(int(options.get("tasks", "8")), len(self.addresses)))
        several = lambda x: json.loads(x) if x.startswith("[") else [x]
        headers = json.loads(options.get("headers", "{}"))
        fetches = [FolderFetch(x) for x in several(options["folder"])] if "folder" in options else [HttpFetch(x, headers) for x in several(options["url"])]
        self.fetch: Fetch = AnyOf(*fetches) if len(fetches) > 1 else fetches[0]
        self.polled = False

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "store"} | {"kind": self.store.type_name}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.store = fs.LocalFileSystem() if state["kind"] == "local" else fs.FileSystem.from_uri(f"{state['kind']}://{self.progress}")[0]

    def _file(self, round_: int, block: int) -> str:
        return f"{self.progress}/round-{round_:08d}/block-{block}.json"

    def _cursors(self, round_: int, block: int) -> dict[str, dict]:
        if round_ < 1:
            return {}
        with self.store.open_input_stream(self._file(round_, block)) as f:
            return json.loads(f.read())

    def _ended(self) -> int:
        """The last round of which every block has left its cursors."""
        folders = self.store.get_file_info(fs.FileSelector(self.progress, allow_not_found=True))
        for n in sorted((int(x.base_name[6:]) for x in folders if x.base_name.startswith("round-")), reverse=True):
            if all(x.type == fs.FileType.File for x in self.store.get_file_info([self._file(n, b) for b in range(self.blocks)])):
                return n
        return 0

    def initialOffset(self) -> dict:
        return {"round": 0}

    def latestOffset(self, *_) -> dict:
        """A run polls once; then there is another round as long as an address has pages left that can be read."""
        ended = self._ended()
        left = any(c["state"] == "open" for b in range(self.blocks) for c in self._cursors(ended, b).values())
        if self.polled and not left:
            return {"round": ended}
        self.polled = True
        return {"round": ended + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Block(b, n) for n in range(start["round"] + 1, end["round"] + 1) for b in range(self.blocks)]

    def read(self, partition: _Block) -> Iterator[tuple]:
        n = partition.round
        cursors = self._cursors(n - 1, partition.number)
        for address in self.addresses[partition.number :: self.blocks]:
            at = cursors.get(address) or {"cursor": self.start, "page": 0, "seen": 0, "state": "open"}
            cursors[address] = at
            yield from self._pages(address, at, n)
        path = self._file(n, partition.number)
        self.store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with self.store.open_output_stream(part := f"{path}.{uuid.uuid4().hex}") as f:
            f.write(json.dumps(cursors).encode())
        self.store.move(part, path)

    def _pages(self, address: str, at: dict, n: int) -> Iterator[tuple]:
        """Rows of the next pages; `at` moves on. A page's items are given once, however often it is read."""
        if at["state"] == "capped":
            return
        pages = at.pop("pages", self.pages)
        for _ in range(pages):
            if self.most and at["page"] >= self.most:
                message = f"stopped after {at['page']} pages at cursor {at['cursor']}"
                if self.raises:
                    raise ValueError(f"{address}: {message}")
                at["state"] = "capped"
                yield address, n, at["page"], None, CAPPED, None, message
                return
            status, body = patient(self.fetch, address, at["cursor"], self.tries, self.wait)
            items, following, error = [], None, None
            if 200 <= status < 300:
                try:
                    page = json.loads(body)
                    items, following = list(page["items"]), page.get("next")
                except (ValueError, KeyError, TypeError, AttributeError) as e:
                    status, error = BAD_PAGE, f"{type(e).__name__}: {e}"
            else:
                error = body[:500]
            if error is not None:
                at["state"] = "failed"  # the next run asks again
                yield address, n, at["page"], None, status, None, error
                return
            for pos in range(at["seen"], len(items)):
                yield address, n, at["page"], pos, status, json.dumps(items[pos]), None
            if following is None:
                at |= {"seen": max(at["seen"], len(items)), "state": "done"}
                return
            at |= {"cursor": str(following), "page": at["page"] + 1, "seen": 0, "state": "open"}
        at["pages"] = min(pages * self.growth, max(self.pages, MOST_PAGES))


class EndpointSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "endpoint"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> EndpointReader:
        return EndpointReader(self.options)


def stream(spark: SparkSession, addresses: list[str], progress: str, **options: object) -> DataFrame:
    """The stream of an endpoint's items (see EndpointReader for options)."""
    spark.dataSource.register(EndpointSource)
    reader = spark.readStream.format("endpoint").option("addresses", json.dumps(addresses)).option("progress", progress)
    return reader.options(**{k: json.dumps(v) if isinstance(v, (list, dict)) else str(v) for k, v in options.items()}).load()


def write_pages(pages: DataFrame, folder: str) -> None:
    """Pages (address, cursor, body) as files that FolderFetch finds. A folder for each page is slow to make, however few bytes
    there are: pages are dealt over all cores, and tasks move their files into place, not the driver one by one."""
    dealt = pages.select("address", "cursor", "body").repartition(pages.sparkSession.sparkContext.defaultParallelism, "address", "cursor")
    dealt.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("address", "cursor").text(folder)


def parsed(rows: DataFrame, schema: str) -> DataFrame:
    """The items of an endpoint's rows: (address, page, pos, and the item's fields)."""
    return rows.filter("item is not null").select("address", "page", "pos", F.from_json("item", schema).alias("i")).select("address", "page", "pos", "i.*")


def failures(rows: DataFrame) -> DataFrame:
    """(address, page, status, error): the last failure of each address that has not been read further since."""
    ended = rows.groupBy("address").agg(F.max_by(F.struct("page", "status", "error"), F.struct("round", "page", F.col("error").isNotNull())).alias("e"))
    return ended.select("address", "e.*").filter("error is not null")
