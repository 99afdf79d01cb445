"""Client profiles: patterns, codes, tolerances and rules of their own by client, picked by the longest key in the
client's name. Rules are column functions, so that many clients with rules of their own are one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from importlib.metadata import entry_points

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saldora.functions.patterns import found_in


@dataclass(frozen=True)
class Profile:
    name: str
    keys: tuple[str, ...] = ()
    noise: tuple[str, ...] = ()
    entity_codes: tuple[str, ...] = ()
    tolerance: float = 0.02
    section_types: dict[str, str] = field(default_factory=dict)
    rules: dict[str, Callable[..., Column]] = field(default_factory=dict)


class Registry:
    """Explicit registry; problems are rows, not exceptions. Of a repeated key the last profile counts."""

    def __init__(self, default: Profile | None = None):
        self.default, self.by_key, self.problems = default or Profile("standard"), {}, []

    def add(self, profile: Profile) -> None:
        for key in (k.lower() for k in profile.keys):
            if key in self.by_key:
                self.problems.append((profile.name, f"key {key} was taken by {self.by_key[key].name}"))
            self.by_key[key] = profile

    def load(self, group: str = "saldora.profiles") -> None:
        """Adds the profiles that installed packages name in a group of entry points; what cannot be loaded, or is no
        profile, is a problem. Nothing is run from folders of data."""
        for point in entry_points(group=group):
            try:
                profile = point.load()
                if not isinstance(profile, Profile):
                    raise TypeError("not a Profile")
                self.add(profile)
            except Exception as e:  # errors are data
                self.problems.append((point.name, f"{type(e).__name__}: {e}"))

    def profiles(self) -> list[Profile]:
        return sorted({p.name: p for p in [*self.by_key.values(), self.default]}.values(), key=lambda p: p.name)

    def apply(self, rule: str, profile: Column, default: Callable[..., Column], *columns: Column) -> Column:
        """The rule of each row's profile over the columns, in one expression; profiles without one use the default."""
        out = default(*columns)
        for p in self.profiles():
            if rule in p.rules:
                out = F.when(profile == p.name, p.rules[rule](*columns)).otherwise(out)
        return out

    def frame_of_problems(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.problems, "profile string, problem string")

    def pick(self, client: str) -> Profile:
        found = [k for k in self.by_key if k in client.lower()]
        return self.by_key[max(found, key=lambda k: (len(k), k))] if found else self.default

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, p.name, float(p.tolerance)) for k, p in sorted(self.by_key.items())], "key string, profile string, tolerance double")


def pick(clients: DataFrame, registry: DataFrame, default: str = "standard") -> DataFrame:
    """client, profile: the profile of the longest key (key, profile of a registry) in the client's name."""
    names = clients.select("client").distinct()
    hits = found_in(names.withColumn("low", F.lower("client")), ["client"], "low", registry.select(F.col("key").alias("pattern")))
    best = hits.join(registry.withColumnRenamed("key", "pattern"), "pattern").groupBy("client").agg(F.max(F.struct(F.length("pattern"), "pattern", "profile")).alias("b"))
    return names.join(best, "client", "left").select("client", F.coalesce("b.profile", F.lit(default)).alias("profile"))


def without_noise(pages: DataFrame, registry: Registry) -> DataFrame:
    """pages (with a column profile) with the lines that are noise to their profile emptied: those that hold one of its
    patterns, or that its rule "noise" names. An empty line is what noise of any kind is to items.extract_items()."""
    def noise(line: Column) -> Column:
        patterns = F.lit(False)
        for p in registry.profiles():
            for pattern in p.noise:
                patterns = patterns | ((F.col("profile") == p.name) & line.rlike("(?Ui)" + pattern))
        return patterns | registry.apply("noise", F.col("profile"), lambda _: F.lit(False), line)

    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return pages.withColumn("text", F.array_join(F.transform(lines, lambda x: F.when(noise(x), F.lit("")).otherwise(x)), "\n"))


def voucher_types(files: DataFrame, registry: Registry, default: Callable[..., Column]) -> DataFrame:
    """files (with a column profile and text) with source_type by the rule "voucher_type" of their profile."""
    return files.withColumn("source_type", registry.apply("voucher_type", F.col("profile"), default, F.col("text")))
