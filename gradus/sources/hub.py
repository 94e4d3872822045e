"""The catalogue of data sets: what there is of each, where it lies, and loading by name with checks and samples."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import rows as R
from . import loaders


@dataclass(frozen=True)
class Info:
    """A row of the catalogue."""

    name: str
    variants: tuple[str, ...]
    splits: tuple[str, ...]
    languages: tuple[str, ...] = ("en",)
    problem_types: tuple[str, ...] = ("OE",)
    modalities: tuple[str, ...] = ("text",)
    domains: tuple[str, ...] = ()


CATALOGUE = {
    x.name: x
    for x in (
        Info("phybench", ("full", "fullques", "onlyques"), ("train",), domains=tuple(sorted(set(loaders.PHYBENCH.values())))),
        Info("phyx", ("test_mini",), ("test_mini",), problem_types=("MC", "OE"), modalities=("text", "image")),
        Info("seephys", ("full",), ("train",), ("en", "zh"), modalities=("text", "image")),
        Info("ugphysics", ("mini", "full"), ("test",), ("en", "zh"), domains=tuple(sorted(loaders.UGPHYSICS.values()))),
        Info("jeebench", ("full",), ("test",), problem_types=("MC", "OE")),
        Info("tpbench", ("full",), ("public",), domains=tuple(sorted(loaders.TPBENCH.values()))),
        Info("physreason", ("full", "mini"), ("test",)),
    )
}
#: Who to cite: title and where it is found.
CITATIONS = {
    "physreason": ("PhysReason: A Comprehensive Benchmark towards Physics-Based Reasoning", "https://aclanthology.org/2025.acl-long.811"),
    "seephys": ("SeePhys (visual physics reasoning)", "https://openreview.net/pdf?id=APNWmytTCS"),
    "phybench": ("PHYBench (physical perception and reasoning)", ""),
    "ugphysics": ("UGPhysics (undergraduate physics reasoning)", ""),
    "phyx": ("PhyX (physical reasoning)", "https://arxiv.org/abs/2505.15929"),
}
CACHE = "DATASET_CACHE_DIR"
Reader = Callable[..., DataFrame]


def default_of(choices: tuple[str, ...]) -> str | None:
    """'full' where there is one, else the first."""
    return "full" if "full" in choices else choices[0] if choices else None


def checked(choices: tuple[str, ...], wanted: str | None, what: str) -> str | None:
    if wanted is None:
        return default_of(choices)
    if choices and wanted not in choices:
        raise ValueError(f"no {what} {wanted}; there are {', '.join(choices)}")
    return wanted


def resolve_data_dir(data_dir: str | None, name: str, environment: Mapping[str, str] = os.environ) -> str:
    """The folder named, else the data set's below the cache's."""
    if data_dir:
        return data_dir
    return f"{environment.get(CACHE) or os.path.expanduser('~/PHYSICAL_REASONING_DATASETS')}/{name.lower()}"


def citation(name: str) -> tuple[str, str] | None:
    return CITATIONS.get(name.lower())


class Hub:
    """A registry of readers (spark, path, **how) and of downloaders. The built-in ones are always there."""

    def __init__(self) -> None:
        self.readers: dict[str, Reader] = dict(loaders.LOADERS)
        self.infos: dict[str, Info] = dict(CATALOGUE)
        self.downloaders: dict[str, Callable[[str], object]] = {}

    def register(self, name: str, reader: Reader, info: Info | None = None) -> Hub:
        self.readers[name.lower()] = reader
        self.infos[name.lower()] = info or Info(name.lower(), (), ())
        return self

    def register_downloader(self, name: str, fetch: Callable[[str], object]) -> Hub:
        """`fetch` fills a folder with the data set's files."""
        self.downloaders[name.lower()] = fetch
        return self

    def available(self) -> list[str]:
        return sorted(self.readers)

    def info(self, name: str) -> dict:
        self.reader(name)
        return asdict(self.infos[name.lower()]) | {"reader": self.readers[name.lower()].__name__}

    def catalogue(self, spark: SparkSession) -> DataFrame:
        rows = [(x.name, [*x.variants], [*x.splits], [*x.languages], [*x.problem_types], [*x.modalities]) for x in self.infos.values()]
        return spark.createDataFrame(rows, "name string, variants array<string>, splits array<string>, languages array<string>, problem_types array<string>, modalities array<string>")

    def reader(self, name: str) -> Reader:
        if name.lower() not in self.readers:
            raise ValueError(f"no such dataset: {name}; there are {', '.join(self.available())}")
        return self.readers[name.lower()]

    def load(
        self,
        spark: SparkSession,
        name: str,
        path: str | None = None,
        *,
        variant: str | None = None,
        split: str | None = None,
        sample_size: int | None = None,
        seed: int = 0,
        auto_download: bool = False,
        **how: object,
    ) -> DataFrame:
        """Check variant and split, find the folder, read, and keep `sample_size` rows of the least md5 keys.

        phybench won't give more rows than it has, others give all. A folder that isn't there is fetched first if a
        downloader is registered and `auto_download` is set, else FileNotFoundError.
        """
        reader, info = self.reader(name), self.infos[name.lower()]
        variant, split = checked(info.variants, variant, "variant"), checked(info.splits, split, "split")
        path = resolve_data_dir(path, name)
        if not exists(spark, path):
            if not auto_download or name.lower() not in self.downloaders:
                raise FileNotFoundError(path)
            try:
                self.downloaders[name.lower()](path)
            except Exception as error:
                raise RuntimeError(f"{name} can't be downloaded") from error
        takes = reader.__code__.co_varnames[: reader.__code__.co_argcount + reader.__code__.co_kwonlyargcount]
        given = {k: v for k, v in {"variant": variant, "split": split}.items() if k in takes and v is not None}
        if "sample_size" in takes:
            return reader(spark, path, **given, **how, sample_size=sample_size)
        problems = reader(spark, path, **given, **how)
        if sample_size is None:
            return problems
        if name.lower() == "phybench" and sample_size > problems.count():
            raise ValueError(f"{name} has fewer than {sample_size} rows")
        return R.sample(problems, sample_size, "problem_id", seed)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
