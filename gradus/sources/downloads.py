"""The offline halves of downloading: fetching is a function that is handed in; pages, files and archives are turned
into what the readers take, and checked. Driver utilities, but for the conversions, which are DataFrame plans."""

from __future__ import annotations

import json
import os
import shutil
import time
import zipfile
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Download:
    """Fills a folder once: nothing is done when `verify` holds, a forced or failed one begins with an empty folder."""

    def __init__(self, name: str, fetch: Callable[[str], object], verify: Callable[[str], bool]):
        self.name, self.fetch, self.verify = name, fetch, verify

    def is_downloaded(self, folder: str) -> bool:
        return os.path.isdir(folder) and self.verify(folder)

    def __call__(self, folder: str, force: bool = False) -> str:
        if not force and self.is_downloaded(folder):
            return folder
        shutil.rmtree(folder, ignore_errors=True)
        os.makedirs(folder)
        self.fetch(folder)
        if not self.verify(folder):
            raise RuntimeError(f"{self.name}: what was fetched isn't whole")
        return folder

    @staticmethod
    def size(folder: str) -> int:
        """Bytes of all files below."""
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)


def paged(page: Callable[[int, int], dict], rows: int = 100, tries: int = 3, wait: float = 5.0) -> Iterator[dict]:
    """The rows of a paged service: `page(offset, length)` gives {rows: [{row}], num_rows_total}."""
    at, total = 0, None
    while total is None or at < total:
        for attempt in range(tries):
            try:
                found = page(at, rows)
                break
            except OSError:
                if attempt == tries - 1:
                    raise
                time.sleep(wait)
        total = found.get("num_rows_total", 0)
        own = [x.get("row", x) for x in found.get("rows", [])]
        if not own:
            return
        yield from own
        at += len(own)


def domain_languages(domains: Iterable[str], languages: Iterable[str]) -> list[tuple[str, str]]:
    """Every domain in every language."""
    languages = list(languages)
    return [(d, x) for d in domains for x in languages]


def fetch_each(parts: Iterable[tuple[str, str]], fetch: Callable[[str, str], list[dict]], folder: str) -> list[tuple[str, str]]:
    """{folder}/{domain}/{language}.jsonl of each part; a part that fails is left out. Gives those that were written."""
    done = []
    for domain, language in parts:
        try:
            rows = fetch(domain, language)
        except Exception:  # noqa: BLE001 - other parts go on
            continue
        os.makedirs(f"{folder}/{domain}", exist_ok=True)
        with open(f"{folder}/{domain}/{language}.jsonl", "w", encoding="utf-8") as out:
            out.writelines(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)
        done.append((domain, language))
    return done


def unpacked(archive: str, folder: str) -> str:
    """Extract a zip; names that would leave the folder are an error."""
    with zipfile.ZipFile(archive) as packed:
        for name in packed.namelist():
            if os.path.isabs(name) or ".." in name.split("/"):
                raise ValueError(f"{archive}: {name}")
        packed.extractall(folder)
    return folder


def is_json_array(path: str) -> bool:
    """Whether the file is a JSON list that isn't empty."""
    try:
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
    except (OSError, ValueError):
        return False
    return isinstance(found, list) and bool(found)


def are_json_lines(path: str, first: int = 3) -> bool:
    """Whether the first lines are JSON objects."""
    try:
        with open(path, encoding="utf-8") as file:
            lines = [x for x, _ in zip(file, range(first), strict=False) if x.strip()]
        return bool(lines) and all(isinstance(json.loads(x), dict) for x in lines)
    except (OSError, ValueError):
        return False


def are_json_objects(folder: str, first: int = 5) -> bool:
    """Whether the first files of a folder are JSON objects."""
    names = sorted(x for x in (os.listdir(folder) if os.path.isdir(folder) else []) if x.endswith(".json"))[:first]
    try:
        return bool(names) and all(isinstance(json.load(open(f"{folder}/{x}", encoding="utf-8")), dict) for x in names)  # noqa: SIM115
    except (OSError, ValueError):
        return False


def is_zip(path: str) -> bool:
    return zipfile.is_zipfile(path) and zipfile.ZipFile(path).testzip() is None


def image_kind(data: Column) -> Column:
    """jpg, png, gif or webp by the first bytes, else png."""
    head = F.hex(F.substring(data, 1, 4))
    return F.when(head.startswith("FFD8FF"), "jpg").when(head == "89504E47", "png").when(head == "47494638", "gif").when(head == "52494646", "webp").otherwise("png")


def safe_json(kind: T.DataType, value: Column) -> Column:
    """A value of which JSON knows the types: bytes as Base64, NaN as null, dates and decimals as text, and so within
    arrays, maps and structs."""
    if isinstance(kind, T.BinaryType):
        return F.base64(value)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value)
    if isinstance(kind, (T.DateType, T.TimestampType, T.DecimalType)):
        return value.cast("string")
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: safe_json(kind.elementType, x))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, x: safe_json(kind.valueType, x))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[safe_json(f.dataType, value[f.name]).alias(f.name) for f in kind]))
    return value


def json_safe(df: DataFrame) -> DataFrame:
    return df.select(*[safe_json(f.dataType, F.col(f.name)).alias(f.name) for f in df.schema])


def split_images(df: DataFrame, key: str, images: str) -> tuple[DataFrame, DataFrame]:
    """Rows with `image_paths` instead of an array of bytes, and the images: path and bytes. One image is named after
    its row, several are numbered from 0. Nulls among them are left out."""
    listed = F.filter(F.coalesce(images, F.array().cast("array<binary>")), lambda x: x.isNotNull())
    number = F.when(F.size(listed) > 1, F.lit(True)).otherwise(False)

    def path(data: Column, k: Column) -> Column:
        name = F.when(number, F.concat_ws("_", F.col(key).cast("string"), k.cast("string"))).otherwise(F.col(key).cast("string"))
        return F.concat(F.lit("images/"), name, F.lit("."), image_kind(data))

    rows = df.withColumn("image_paths", F.transform(listed, path)).drop(images)
    pairs = F.explode(F.transform(listed, lambda x, k: F.struct(path(x, k).alias("path"), x.alias("content"))))
    return rows, df.select(pairs.alias("x")).select("x.path", "x.content")


def write_files(files: DataFrame, folder: str) -> None:
    """Sink: each row (path, content) as a file below a folder that all executors share."""

    def write(rows: Iterator) -> None:
        for row in rows:
            to = os.path.join(folder, row.path)
            os.makedirs(os.path.dirname(to), exist_ok=True)
            with open(to, "wb") as out:
                out.write(row.content)

    files.foreachPartition(write)


def read_images(spark: SparkSession, problems: DataFrame, folder: str, key: str = "problem_id") -> DataFrame:
    """One row per problem: its key and `images`, the bytes of its paths in their order; files that aren't there are
    left out."""
    asked = problems.select(key, F.posexplode("image_paths").alias("at", "path"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    there = there.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content")
    found = asked.withColumn("file", name).join(there, "file", "left").where("content IS NOT NULL")
    listed = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "content"))).alias("x"))
    none = F.array().cast("array<binary>")
    return problems.select(key).join(listed, key, "left").select(key, F.coalesce(F.transform("x", lambda x: x["content"]), none).alias("images"))
