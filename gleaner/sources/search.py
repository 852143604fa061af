"""Result pages of a search as a data source: a partition for each page, domains, recency and locale pushed into the read.

Pages are folders page=1, page=2 and so on of JSON lines, as `write_pages` leaves them. The filters that a search service takes as
parameters (sites to include or to leave out, the least time of publication, a language, pages) are taken from the query's
conditions, so that what they rule out never leaves the page; all others stay with Spark.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, Not

from ..operators.ordering import ordinals

SCHEMA = "rank long, url string, site string, title string, language string, published timestamp, page int"


@dataclass
class Asked:
    """Parameters of a search."""

    include: set[str] | None = None
    exclude: set[str] = field(default_factory=set)
    languages: set[str] | None = None
    since: dt.datetime | None = None
    first: int = 1
    last: int | None = None

    def takes(self, f: Filter) -> bool:
        """Take a condition over as a parameter, if it is one."""
        if isinstance(f, Not):
            inner = f.child
            if isinstance(inner, (EqualTo, In)) and inner.attribute == ("site",):
                self.exclude |= {inner.value} if isinstance(inner, EqualTo) else set(inner.value)
                return True
            return False
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if isinstance(f, (EqualTo, In)) and name in ("site", "language"):
            held = {f.value} if isinstance(f, EqualTo) else set(f.value)
            mine = "include" if name == "site" else "languages"
            setattr(self, mine, held if getattr(self, mine) is None else getattr(self, mine) & held)
            return True
        if isinstance(f, GreaterThanOrEqual) and name == "published":
            self.since = max(self.since or f.value, f.value)
            return True
        if isinstance(f, (LessThan, LessThanOrEqual)) and name == "page":
            most = f.value - isinstance(f, LessThan)
            self.last = most if self.last is None else min(self.last, most)
            return True
        if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and name == "page":
            self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            return True
        if isinstance(f, EqualTo) and name == "page":
            self.first, self.last = max(self.first, f.value), f.value if self.last is None else min(self.last, f.value)
            return True
        return False

    def wants(self, site: str | None, language: str | None, published: dt.datetime | None) -> bool:
        if self.include is not None and site not in self.include or self.exclude and (site is None or site in self.exclude):
            return False
        return (self.languages is None or language in self.languages) and (self.since is None or published is not None and published >= self.since)


class Page(InputPartition):
    def __init__(self, number: int, files: list[str]):
        super().__init__(number)
        self.files = files


class PageReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
        self.asked = Asked()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self.asked.takes(f):
                yield f

    def partitions(self) -> list[Page]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        pages: dict[int, list[str]] = {}
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            folder, _, name = info.path.rpartition("/")
            number = folder.rpartition("page=")[2]
            if info.is_file and name.endswith(".json") and number.isdigit() and self.asked.first <= int(number) <= (self.asked.last or int(number)):
                pages.setdefault(int(number), []).append(info.path)
        return [Page(n, sorted(pages[n])) for n in sorted(pages)]

    def read(self, partition: Page) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        for name in partition.files:
            with store.open_input_stream(name) as lines:
                for line in lines.read().splitlines():
                    r = json.loads(line)
                    at = dt.datetime.fromisoformat(r["published"]) if r.get("published") else None
                    if self.asked.wants(r.get("site"), r.get("language"), at):
                        yield r["rank"], r.get("url"), r.get("site"), r.get("title"), r.get("language"), at, partition.value


class SearchPages(DataSource):
    """spark.read.format("search_pages").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "search_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"])


def write_pages(results: DataFrame, order: str, path: str, per_page: int = 10) -> None:
    """Results (url, site, title, language, published) as pages by a unique numeric order, ranks from 1."""
    ranked = ordinals(results, order, name="rank")
    page = F.ceil(F.col("rank") / per_page).cast("int")
    said = F.date_format(F.col("published").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    ranked.select("rank", "url", "site", "title", "language", said.alias("published"), page.alias("page")).repartition("page").write.partitionBy("page").json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """All results of the pages under a path; conditions on it are pushed where the search takes them."""
    spark.dataSource.register(SearchPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    # a condition that always holds: without any, Spark reads with what an earlier query of this table had pushed
    return spark.read.format("search_pages").load(path).where("rank is not null")
