"""Tables as immutable segments with tombstones: a change writes its own rows only.

Each run adds a segment to every table, whose rows carry the run's number (`gen`), and tombstones: (path, gen) takes back
the rows of that path with a smaller number, (caller_id, pos, gen) those of one call. What is live is what no tombstone
takes back. Segments are sorted by the table's key, so that a filter on it reads few row groups.

When what has changed exceeds a quarter of the first segment, all live rows become the first segment again; when small
segments are many, they become one. So a row is written a bounded number of times for each quarter that changes.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import scratch

TOMBSTONES = {"dead_paths": ["path"], "dead_calls": ["caller_id", "pos"]}
#: Tombstones up to this many are sent to every task; more are joined.
MOST_SENT = 100_000


class Segments:
    """The tables under `base` as `state` (a value for a manifest) lists them. `add` writes under a version's folder and lists what it wrote in a state of its own."""

    def __init__(self, spark: SparkSession, base: str, state: dict | None = None, version: str = ""):
        self.spark, self.base, self.version = spark, base, version
        self.state = copy.deepcopy(state) if state else {"gen": -1, "tables": {}}
        if version:
            self.state["gen"] += 1

    @property
    def gen(self) -> int:
        return self.state["gen"]

    def rows(self, name: str) -> list[int]:
        """Rows of each segment."""
        return [s["rows"] for s in self.state["tables"].get(name, {"segments": []})["segments"]]

    def versions(self) -> set[str]:
        return {s["at"].partition("/")[0] for t in self.state["tables"].values() for s in t["segments"]}

    def add(self, name: str, df: DataFrame, order: Sequence[str], small: bool = False, rows: int = 0) -> DataFrame:
        """Write `df` as the table's next segment, and return it; small: as one file, without looking for ranges first; rows: about how many there are, if known, for as many partitions as these need."""
        table = self.state["tables"].setdefault(name, {"order": list(order), "segments": []})
        df = df if "gen" in df.columns else df.withColumn("gen", F.lit(self.gen))
        at = f"{self.version}/{name}-{len(table['segments'])}"
        dealt = df.coalesce(1).sortWithinPartitions(*order) if small else scratch.by_range(df, rows, order)
        dealt.write.parquet(f"{self.base}/{at}")
        table.setdefault("schema", df.schema.json())
        out = self.spark.read.schema(df.schema).parquet(f"{self.base}/{at}")
        table["segments"].append({"at": at, "rows": out.count()})
        return out

    def bury(self, name: str, keys: DataFrame, small: bool = False) -> None:
        """Tombstones for the rows of earlier runs with these keys."""
        self.add(name, keys.select(*TOMBSTONES[name]), TOMBSTONES[name], small)

    def read(self, name: str, first: int = 0) -> DataFrame:
        """All rows of the segments from `first` on."""
        table = self.state["tables"][name]
        held = [s for s in table["segments"][first:] if s["rows"]] or table["segments"][:1]
        schema = StructType.fromJson(json.loads(table["schema"]))
        out = self.spark.read.schema(schema).parquet(*[f"{self.base}/{s['at']}" for s in held])
        return out if any(s["rows"] for s in table["segments"][first:]) else out.limit(0)

    def live(self, name: str, first: int = 0) -> DataFrame:
        """The rows that no tombstone takes back, with their `gen`."""
        df = self.read(name, first)
        for stones, keys in TOMBSTONES.items():
            n = sum(self.rows(stones))
            if n and name not in TOMBSTONES and set(keys) <= set(df.columns):
                dead = self.read(stones).groupBy(*keys).agg(F.max("gen").alias("dead_gen"))
                df = df.join(F.broadcast(dead) if n <= MOST_SENT else dead, keys, "left").where("dead_gen IS NULL OR gen >= dead_gen").select(*df.columns)
        return df

    def merge(self, leading: str, version: str, most: int = 8) -> Segments | None:
        """These tables in fewer segments under `version`, if `leading`'s have changed by more than a quarter or are more than `most`."""
        first, *later = self.rows(leading) or [0]
        whole = 4 * (sum(later) + sum(self.rows("dead_paths"))) > first
        if not later and not self.rows("dead_paths") or not whole and len(later) < most:
            return None
        out = Segments(self.spark, self.base, {"gen": self.gen, "tables": {}})
        out.version = version
        for name, table in self.state["tables"].items():
            if whole and name in TOMBSTONES:
                continue
            if whole or name in TOMBSTONES:
                out.add(name, self.live(name), table["order"], rows=sum(self.rows(name)))
            else:
                out.state["tables"][name] = table | {"segments": table["segments"][:1]}
                if len(table["segments"]) > 1:
                    out.add(name, self.live(name, 1), table["order"], rows=sum(self.rows(name)[1:]))
        return out
