"""Fingerprints of datasets as hash trees, of models, and the ledger that lets a test set be opened once per dataset."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import with_rank

#: Children of a node of a fingerprint's tree.
FAN = 1024


def hash_tree(df: DataFrame, row_id: str, columns: list[str]) -> list[DataFrame]:
    """Levels of a hash tree over the rows, leaves first: node, n_rows, digest. The last level is one node (none without rows).

    A leaf holds a run of ``FAN`` places in the order of (row_id, values), a node ``FAN`` nodes of the level below, so that no group is
    larger whatever the ids are. A number is put as the shortest text that only it has as 32 bits; both noughts are one, all that is no number is another.
    """
    value = [F.coalesce((F.col(f"`{c}`").cast("float") + F.lit(0.0).cast("float")).cast("string"), F.lit("-")) for c in columns]
    rows = df.select(F.col(row_id).alias("_id"), F.sha2(F.concat_ws("|", *value), 256).alias("_h"))
    n = rows.count()
    held = with_rank(rows, "_id", "_h", bucket="_part").select("_part", (F.col("rank") - 1).alias("_at"), "_h").withColumn("_up", F.floor(F.col("_at") / FAN))
    # rows lie by stretches of the order: a leaf within one is made there, only pieces of those across an edge go on as texts
    joined = F.array_join(F.sort_array(F.collect_list(F.struct("_at", "_h"))).getField("_h"), "")
    pieces = held.groupBy("_part", "_up").agg(joined.alias("_text"), F.min("_at").alias("_at"), F.count(F.lit(1)).alias("n_rows"))
    whole = F.col("n_rows") == FAN
    pieces = pieces.select("_up", "_at", "n_rows", F.when(whole, F.sha2("_text", 256)).alias("_whole"), F.when(~whole, F.col("_text")).alias("_h"))
    together = F.sha2(joined, 256)
    leaves = pieces.groupBy("_up").agg(F.coalesce(F.max("_whole"), together).alias("_h"), F.sum("n_rows").alias("n_rows"))
    levels, nodes = [], -(-n // FAN)
    while True:
        held = leaves.withColumnRenamed("_up", "_at")
        levels.append(held.select(F.col("_at").alias("node"), "n_rows", F.col("_h").alias("digest")))
        if nodes <= 1:
            return levels
        leaves = held.groupBy(F.floor(F.col("_at") / FAN).alias("_up")).agg(together.alias("_h"), F.sum("n_rows").alias("n_rows"))
        nodes = -(-nodes // FAN)


def changed_leaves(one: DataFrame, other: DataFrame) -> DataFrame:
    """node, first_place, last_place of leaves (first levels of ``hash_tree``) that differ or are in one of the two only; places count from 0."""
    both = one.select("node", F.col("digest").alias("_a"), F.col("n_rows").alias("_n")).join(other.select("node", F.col("digest").alias("_b"), F.col("n_rows").alias("_m")), "node", "full")
    rows = F.greatest(F.coalesce("_n", F.lit(0)), F.coalesce("_m", F.lit(0)))
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("node", (F.col("node") * FAN).alias("first_place"), (F.col("node") * FAN + rows - 1).alias("last_place"))


def fingerprint(df: DataFrame, row_id: str, inputs: list[str], outputs: list[str] | None = None, levels: dict[str, int] | None = None) -> DataFrame:
    """One row: n_rows, digest of the values as 32-bit numbers, their order by row id, and the kinds of the columns; names and the ids themselves don't count.

    Each input has a tag, with its number of levels if it is a category (``levels``), so that a category isn't taken for a quantity. Built
    from the top of ``hash_tree``. The number of rows is counted while the plan is made.
    """
    return sealed(hash_tree(df, row_id, [*inputs, *(outputs or [])])[-1], inputs, outputs, levels)


def sealed(top: DataFrame, inputs: list[str], outputs: list[str] | None = None, levels: dict[str, int] | None = None) -> DataFrame:
    """The one row of ``fingerprint`` from a level of ``hash_tree``. Of several nodes it takes the greatest digest: only the last level stands for all rows."""
    tags = ",".join([*(f"K{levels[c]}" if levels and c in levels else "C" for c in inputs), f"inputs {len(inputs)}", f"outputs {len(outputs or [])}"])
    one = top.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.max("digest").alias("_h"))
    return one.select("n_rows", F.sha2(F.concat(F.lit(tags + ";"), F.coalesce("_h", F.lit(""))), 256).alias("digest"))


def model_fingerprint(layers: list[dict]) -> str:
    """Digest of a network: kinds, shapes and weights as 32-bit numbers, where both noughts are one and all that is no number another."""
    digest = hashlib.sha256()
    for layer in layers:
        digest.update(json.dumps({k: v for k, v in layer.items() if isinstance(v, (str, int, bool))}, sort_keys=True).encode())
        for k in sorted(k for k, v in layer.items() if not isinstance(v, (str, int, bool))):
            values = np.asarray(layer[k], np.float32) + np.float32(0)
            digest.update(f"{k}{values.shape}".encode() + np.where(np.isnan(values), np.float32("nan"), values).astype("<f4").tobytes())
    return digest.hexdigest()


def stamp(spec: dict) -> str:
    """Digest of a candidate's settings."""
    return hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest()


class Refused(RuntimeError):
    """A test was asked for that may not be opened."""


@dataclass
class Ledger:
    """What was checked on the current dataset, and the datasets whose test set is known already."""

    dataset: str
    checked: str | None = None
    finalized: str | None = None
    disclosed: dict[str, str] = field(default_factory=dict)

    def record_check(self, spec: dict) -> None:
        self.checked = stamp(spec)

    def change_dataset(self, dataset: str) -> None:
        """A check counts for its dataset only; disclosures stay."""
        self.dataset, self.checked, self.finalized = dataset, None, None

    def finalize(self, spec: dict) -> None:
        """Open the test set for these settings, or say why not: disclosed first, then not checked, then stale."""
        if self.dataset in self.disclosed:
            raise Refused("AlreadyFinalized" if self.disclosed[self.dataset] == stamp(spec) else "TestDisclosed")
        if self.checked is None:
            raise Refused("NotChecked")
        if self.checked != stamp(spec):
            raise Refused("Stale")
        self.finalized = self.disclosed[self.dataset] = stamp(spec)


# ---- the ledger as a table


_EVENT = "seq long, kind string, dataset string, stamp string"


class SharedLedger:
    """The same rules for many drivers on one folder: an append-only table of events, and one claim for each dataset whose test was opened.

    Every event is a file that is created only if it isn't there (its name is the next number; who comes second takes the one after), and so is a
    dataset's claim. So of two drivers that open the test of one dataset at once exactly one succeeds, and a claim outlives all of them. The folder's
    file system must create files atomically, as HDFS and local ones do.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        for part in ("events", "claims"):
            self._fs.mkdirs(self._path(f"{self.folder}/{part}"))

    def _create(self, name: str, row: dict) -> bool:
        """Whether the file wasn't there and now is."""
        path = self._path(f"{self.folder}/{name}")
        if not self._fs.createNewFile(path):
            return False
        out = self._fs.create(path, True)
        out.write(bytearray((json.dumps(row) + "\n").encode()))
        out.close()
        return True

    def events(self) -> DataFrame:
        """seq, kind (check, test), dataset, stamp: all that was recorded."""
        return self.spark.read.schema(_EVENT).json(f"{self.folder}/events").where("seq is not null")

    def claims(self) -> DataFrame:
        """dataset, stamp of every test that was opened."""
        return self.spark.read.schema("dataset string, stamp string").json(f"{self.folder}/claims").where("dataset is not null")

    def _append(self, kind: str, dataset: str, stamped: str) -> None:
        seq = self.events().agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
        while not self._create(f"events/{seq:012d}.json", {"seq": seq, "kind": kind, "dataset": dataset, "stamp": stamped}):
            seq += 1

    def record_check(self, dataset: str, spec: dict) -> None:
        """The latest check of a dataset replaces the one before."""
        self._append("check", dataset, stamp(spec))

    def _claimed(self, dataset: str) -> str | None:
        """The stamp of the dataset's claim. A claim whose writer hasn't filled it in yet counts as another's."""
        name = self._path(f"{self.folder}/claims/{hashlib.sha256(dataset.encode()).hexdigest()}.json")
        if not self._fs.exists(name):
            return None
        for _ in range(20):
            found = self.claims().where(F.col("dataset") == dataset).first()
            if found is not None:
                return found["stamp"]
            time.sleep(0.1)
        return ""

    def finalize(self, dataset: str, spec: dict) -> None:
        """Open the test set for these settings, or say why not: disclosed first, then not checked, then stale."""
        own, claimed = stamp(spec), self._claimed(dataset)
        if claimed is not None:
            raise Refused("AlreadyFinalized" if claimed == own else "TestDisclosed")
        last = self.events().where((F.col("kind") == "check") & (F.col("dataset") == dataset)).agg(F.max_by("stamp", "seq")).first()[0]
        if last is None:
            raise Refused("NotChecked")
        if last != own:
            raise Refused("Stale")
        if not self._create(f"claims/{hashlib.sha256(dataset.encode()).hexdigest()}.json", {"dataset": dataset, "stamp": own}):
            raise Refused("TestDisclosed")
        self._append("test", dataset, own)
