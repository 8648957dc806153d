"""Pages of a catalog's JSON interface, and a data source that lists them."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from ..functions.keys import SAFE, parse_pack_key, safe_integer
from ..functions.status import DEFAULT_PAUSE
from ..operators.lookup import distinct_ids

PAGE = 100
_RECORD = "struct<id:string,key:string,version:string,ref:string,size_in_bytes:string,created_at:string>"
#: Names of the text fields, and of the numbers.
TEXTS, NUMBERS = ("key", "version", "ref", "created_at"), ("id", "size_in_bytes")


def _typed(raw: Column, name: str, quoted: bool) -> Column:
    """Whether a record's field is a text (quoted) or a number."""
    return raw.rlike(rf'"{name}"\s*:\s*"') if quoted else raw.rlike(rf'"{name}"\s*:\s*[0-9]')


def records(pages: DataFrame, body: str = "body") -> DataFrame:
    """id, key, version, ref, size_bytes and created_at of all well-formed records; a malformed page fails the query."""
    total = safe_integer(F.get_json_object(body, "$.total_count"))
    raw = F.from_json(F.get_json_object(body, "$.actions_caches"), "array<string>")
    good = total.isNotNull() & raw.isNotNull() & (F.size(raw) <= PAGE)
    checked = F.when(good, raw).otherwise(F.raise_error(F.lit("the catalog's answer is malformed")).cast("array<string>"))
    rows = pages.select(F.explode(checked).alias("raw")).select("raw", F.from_json("raw", _RECORD).alias("r"))
    fits = [_typed(F.col("raw"), n, True) for n in TEXTS] + [_typed(F.col("raw"), n, False) for n in NUMBERS]
    created = F.try_to_timestamp("r.created_at")
    for f in fits:
        rows = rows.where(f)
    number = lambda n: safe_integer(F.col(f"r.{n}"))
    out = rows.select(number("id").alias("id"), "r.key", "r.version", "r.ref", number("size_in_bytes").alias("size_bytes"), created.alias("created_at"))
    return out.where(F.col("id").isNotNull() & F.col("size_bytes").isNotNull() & F.col("created_at").isNotNull())


#: Bytes of an answer at most, pages of a ref at most, seconds of a request.
MOST_BYTES, MOST_PAGES, TIMEOUT = 4 << 20, 100, 30.0
LISTED = "id long, key string, version string, ref string, size_bytes long, created_at timestamp"


class CatalogError(RuntimeError):
    """A listing that cannot be used; `limited` and `retry_ms` say whether and how long to wait."""

    def __init__(self, message: str, status: int | None = None, retry_ms: int | None = None, limited: bool = False):
        super().__init__(message)
        self.status, self.retry_ms, self.limited = status, retry_ms, limited


def decode_page(raw: bytes) -> tuple[int, int, list[tuple]]:
    """Total count, rows seen and well-formed records (as LISTED, the time still a text) of an answer."""
    try:
        page = json.loads(raw)
        total, rows = page["total_count"], page["actions_caches"]
    except (ValueError, TypeError, KeyError):
        raise CatalogError("the catalog's answer is malformed") from None
    whole = lambda n: isinstance(n, int) and not isinstance(n, bool) and 0 <= n <= SAFE
    if not whole(total) or not isinstance(rows, list) or len(rows) > PAGE:
        raise CatalogError("the catalog's answer is malformed")
    out = []
    for r in rows:
        if not isinstance(r, dict) or not all(isinstance(r.get(n), str) for n in TEXTS) or not all(whole(r.get(n)) for n in NUMBERS):
            continue
        try:
            made = datetime.fromisoformat(r["created_at"])
        except ValueError:
            continue
        out.append((r["id"], r["key"], r["version"], r["ref"], r["size_in_bytes"], made if made.tzinfo else made.replace(tzinfo=timezone.utc)))
    return total, len(rows), out


def pause_of(status: int, headers: dict[str, str], now: float) -> int | None:
    """Milliseconds that a rate-limited answer asks for; None if it is not one."""
    head = {k.lower(): v.strip() for k, v in headers.items()}
    retry, reset = head.get("retry-after"), head.get("x-ratelimit-reset", "")
    asked = None
    if retry and retry.isdigit():
        asked = int(retry) * 1000
    elif retry and "," in retry:
        try:
            asked = max(0, round((parsedate_to_datetime(retry).timestamp() - now) * 1000))
        except ValueError:
            asked = None
    if status != 429 and not (status == 403 and (asked is not None or head.get("x-ratelimit-remaining") == "0")):
        return None
    if asked is None and reset.isdigit():
        asked = max(0, round((int(reset) - now) * 1000))
    return DEFAULT_PAUSE if asked is None else asked


def fetch(url: str, query: dict[str, str], token: str | None, timeout: float, most: int) -> bytes:
    """One answer of the service, of at most `most` bytes; redirects are errors."""

    class Still(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *args):
            return None

    request = urllib.request.Request(f"{url}?{urllib.parse.urlencode(query)}", headers={"Accept": "application/json", **({"Authorization": f"Bearer {token}"} if token else {})})
    try:
        with urllib.request.build_opener(Still).open(request, timeout=timeout) as answer:
            raw = answer.read(most + 1)
    except urllib.error.HTTPError as e:
        pause = pause_of(e.code, dict(e.headers), time.time())
        if pause is not None:
            raise CatalogError("the catalog is rate limited", e.code, pause, True) from None
        raise CatalogError(f"the catalog answered with status {e.code}", e.code) from None
    except TimeoutError:
        raise CatalogError("the catalog's answer took too long") from None
    except urllib.error.URLError as e:
        late = isinstance(e.reason, TimeoutError)
        raise CatalogError("the catalog's answer took too long" if late else "the catalog cannot be reached") from None
    if len(raw) > most:
        raise CatalogError("the catalog's answer is too large")
    return raw


@dataclass
class RefListing(InputPartition):
    ref: str


class CatalogReader(DataSourceReader):
    """Lists each ref in a task of its own, page by page; ref and prefix go to the service and are checked again."""

    def __init__(self, options: dict[str, str]):
        self.url, self.token = options["url"], options.get("token")
        self.refs = list(dict.fromkeys(r for r in options["refs"].split(",") if r))
        self.prefix = options.get("prefix", "")
        self.pages, self.bytes, self.timeout = int(options.get("maxpages", MOST_PAGES)), int(options.get("maxbytes", MOST_BYTES)), float(options.get("timeout", TIMEOUT))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("ref",):
                self.refs = [r for r in self.refs if r == f.value]
            elif isinstance(f, In) and f.attribute == ("ref",):
                self.refs = [r for r in self.refs if r in f.value]
            elif isinstance(f, StringStartsWith) and f.attribute == ("key",) and f.value.startswith(self.prefix):
                self.prefix = f.value
            # the service's answer is not trusted: every filter is applied again
            yield f

    def partitions(self) -> list[RefListing]:
        return [RefListing(r) for r in self.refs]

    def read(self, partition: RefListing) -> Iterator[tuple]:
        if partition is None:
            return
        for page in range(1, self.pages + 1):
            query = {"key": self.prefix, "ref": partition.ref, "sort": "created_at", "direction": "desc", "per_page": str(PAGE), "page": str(page)}
            total, seen, rows = decode_page(fetch(self.url, query, self.token, self.timeout, self.bytes))
            for r in rows:
                if r[3] == partition.ref and r[1].startswith(self.prefix):
                    yield r
            if seen < PAGE or page * PAGE >= total:
                return
        raise CatalogError("the catalog has more pages than allowed")


class CatalogSource(DataSource):
    """format("catalog"): options url, refs (by commas), prefix, token, maxPages, maxBytes, timeout."""

    @classmethod
    def name(cls) -> str:
        return "catalog"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> CatalogReader:
        return CatalogReader({k.lower(): v for k, v in self.options.items()})


def listing(spark: SparkSession, url: str, refs: list[str], prefix: str, **options: str) -> DataFrame:
    """All records of the refs whose key has the prefix, as the service lists them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CatalogSource)
    return spark.read.format("catalog").options(url=url, refs=",".join(refs), prefix=prefix, **options).load()


def snapshot(records: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Of all listed records the newest of each id whose key has the prefix and is a pack's, with its parts; and a row with the number of keys that are none."""
    newest = distinct_ids(records).where(F.col("key").startswith(prefix)).withColumn("pack", parse_pack_key(F.col("key")))
    return newest.where("pack is not null"), newest.agg(F.count_if(F.col("pack").isNull()).alias("invalid_keys"))
