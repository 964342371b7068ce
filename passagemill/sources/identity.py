"""What a stage's results depend on, as short marks; and where results lie that may be used again."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.sources.files import exists, read_text, write_text

Fact = str | int | float | bool | None
#: The file that says which stages a folder holds, and the folder of results under other marks.
RECORD, OTHERS = "stages.json", "variants"


def table_fingerprint(rows: DataFrame, *columns: str) -> str:
    """Depends on the rows of these columns, not on their order: the count and two sums of hashes, added up by Spark.

    For a corpus in its order, its place is one of the columns. No task needs the whole table. Nulls and empty
    tables have fingerprints of their own, repeated rows count as often as they come.
    """
    ones, twos = (F.xxhash64(*columns).cast("decimal(38,0)"), F.xxhash64(F.lit(1), *reversed(columns)).cast("decimal(38,0)"))
    n, a, b = rows.agg(F.count("*"), F.coalesce(F.sum(ones), F.lit(0)), F.coalesce(F.sum(twos), F.lit(0))).first()
    return f"{n}:{a}:{b}"


@dataclass(frozen=True)
class Stage:
    """A step of the work: its name, the facts its results depend on, and the steps before it."""

    name: str
    facts: dict[str, Fact] = field(default_factory=dict)
    after: tuple[Stage, ...] = ()

    @property
    def mark(self) -> str:
        """Twenty letters and figures that change with any fact, its type, or anything before."""
        digest = hashlib.blake2b(digest_size=10)
        for part in (self.name, *(s.mark for s in self.after)):
            digest.update(f"{len(part)}:{part}|".encode())
        for key in sorted(self.facts):
            value = self.facts[key]
            for part in (key, type(value).__name__, repr(value)):
                digest.update(f"{len(part)}:{part}|".encode())
        return digest.hexdigest()


def graph_stages(corpus: str, questions: str, extractor: str, encoder: str, settings: dict[str, Fact]) -> dict[str, Stage]:
    """Steps of the entity graph's retrieval: what each depends on, and nothing else."""
    extraction = Stage("extraction", {"corpus": corpus, "extractor": extractor})
    vectors = Stage("vectors", {"encoder": encoder}, (extraction,))
    graph = Stage("graph", {}, (extraction,))
    return {s.name: s for s in (extraction, vectors, graph, Stage("ranking", {"questions": questions, **settings}, (graph, vectors)))}


def phrase_stages(corpus: str, questions: str, extractor: str, model: str, encoder: str, settings: dict[str, Fact]) -> dict[str, Stage]:
    """Steps of the phrase graph's retrieval: names asked for don't depend on the corpus, nor triples on the questions."""
    names = Stage("asked_names", {"questions": questions, "extractor": extractor, "model": model})
    triples = Stage("triples", {"corpus": corpus, "extractor": extractor, "model": model})
    graph = Stage("phrase_graph", {"encoder": encoder}, (triples,))
    return {s.name: s for s in (names, triples, graph, Stage("phrase_ranking", {"questions": questions, **settings}, (graph, names)))}


class RunConflict(ValueError):
    """A folder that holds the results of other inputs."""


def _recorded(spark: SparkSession, folder: str) -> dict[str, str] | None:
    record = f"{folder}/{RECORD}"
    return json.loads(read_text(spark, record)) if exists(spark, record) else None


def _write(spark: SparkSession, folder: str, stages: dict[str, Stage]) -> None:
    write_text(spark, json.dumps({n: s.mark for n, s in sorted(stages.items())}, indent=1), f"{folder}/{RECORD}")


def take(spark: SparkSession, folder: str, stages: dict[str, Stage]) -> bool:
    """Takes a folder for these stages: False if it is theirs already, an error if it belongs to others."""
    known = _recorded(spark, folder)
    if known is None:
        _write(spark, folder, stages)
        return True
    if known != {n: s.mark for n, s in stages.items()}:
        raise RunConflict(folder)
    return False


def place_of(spark: SparkSession, root: str, stage: Stage) -> tuple[str, bool]:
    """The folder of a stage's results, and whether Spark finished writing them."""
    folder = f"{root}/{stage.name}/{stage.mark}"
    return folder, exists(spark, f"{folder}/_SUCCESS")


def settle(spark: SparkSession, root: str, stages: dict[str, Stage], shared: str = "extraction") -> tuple[str, str]:
    """Where these stages' results belong, and how that was found.

    ``same``: the root holds exactly these stages. ``upgraded``: it holds some of them and nothing else, so its record
    is completed. ``new``: nothing was there. ``variant``: the root holds others; the results belong in a folder
    below it, to which the table ``shared`` is copied if its stage is the same one.
    """
    known, marks = _recorded(spark, root), {n: s.mark for n, s in stages.items()}
    if known is None:
        _write(spark, root, stages)
        return root, "new"
    if known == marks:
        return root, "same"
    if all(marks.get(n) == m for n, m in known.items()):
        _write(spark, root, stages)
        return root, "upgraded"
    folder = f"{root}/{OTHERS}/{Stage('all', {}, tuple(stages.values())).mark}"
    if _recorded(spark, folder) == marks:
        return folder, "same"
    if known.get(shared) == marks.get(shared) and exists(spark, f"{root}/{shared}/_SUCCESS") and not exists(spark, f"{folder}/{shared}"):
        spark.read.parquet(f"{root}/{shared}").write.parquet(f"{folder}/{shared}")
    _write(spark, folder, stages)
    return folder, "variant"
