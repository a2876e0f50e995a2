"""The query verbs: check, bulk check, list objects, list subjects, for one request or for many at once."""

from __future__ import annotations

import contextlib
import io
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgrove.operators.backward import Backward, listed
from relgrove.operators.common import checkpointed, union_of
from relgrove.operators.forward import Forward, ResolutionTooDeep
from relgrove.operators.paging import page
from relgrove.plans.analysis import MAX_DEPTH, Analysis
from relgrove.plans.model import Computed, FromLink, This, walk
from relgrove.sources.tuples import with_contextual

REQUEST = ["subject_type", "subject_id", "relation", "object_type", "object_id"]


@dataclass(frozen=True)
class Engine:
    """Answers questions over a model and a DataFrame of tuples.

    contextual: further tuples, as rows or a DataFrame, that count for one call.
    """

    analysis: Analysis
    tuples: DataFrame
    max_depth: int = MAX_DEPTH

    def _facts(self, contextual=None) -> DataFrame:
        return with_contextual(self.tuples, contextual)

    def _too_deep(self, node: tuple[str, str]) -> None:
        if self.analysis.userset_depth.get(node, 0) >= self.max_depth:
            raise ResolutionTooDeep(f"{node[0]}.{node[1]} needs {self.max_depth} steps by its schema alone")

    def grants(self, subjects: DataFrame, pairs: list[tuple[str, str]], contextual=None, wildcards: bool = True) -> tuple[DataFrame, bool]:
        """What the subjects hold of the given (object type, relation) pairs, as requests; and whether recursion was cut off."""
        forward = Forward(self.analysis, self._facts(contextual), subjects, wildcards, self.max_depth)
        frames = [forward.value(t, r).select("subject_type", "subject_id", F.lit(r).alias("relation"), F.lit(t).alias("object_type"), "object_id") for t, r in pairs if self.analysis.model.expr(t, r) is not None]
        if not frames:
            return subjects.select("subject_type", "subject_id", F.lit("").alias("relation"), F.lit("").alias("object_type"), F.lit("").alias("object_id")).where("false"), False
        return union_of(frames), bool(forward.truncated)

    def _demand(self, asked: dict[tuple[str, str], DataFrame], tuples: DataFrame) -> tuple[dict | None, set]:
        """The objects of each recursive relation on which the requests depend, and where these were cut off. Other relations are tested row by row."""
        recursive = {n for g in self.analysis.needed(list(asked)) if self.analysis.recursive(g) for n in g}
        if not recursive:
            return None, set()
        down = Backward(self.analysis, tuples, "", "", self.max_depth)
        objects = down.demands(asked)
        return {n: checkpointed(objects[n]) if n in objects else None for n in recursive}, down.cut

    def _local(self, pairs: list[tuple[str, str]]) -> set[tuple[str, str]]:
        """The relations that requests on these concern on the requests' own objects only, as no userset or link leads to them."""
        model, analysis = self.analysis.model, self.analysis
        here, front, led = set(pairs), list(pairs), []
        while front:
            node = front.pop()
            for x in walk(model.expr(*node)):
                if isinstance(x, This | FromLink):
                    led += analysis.depends(node, x)
                elif isinstance(x, Computed) and (n := (node[0], x.relation)) not in here:
                    here.add(n)
                    front.append(n)
        return here - {n for g in analysis.needed(led) for n in g}

    def check_bulk(self, requests: DataFrame, contextual=None, pairs: list[tuple[str, str]] | None = None, errors: bool = False, ids: list[str] | None = None) -> DataFrame:
        """(idx, allowed): 1 or 0 for each row of requests (idx and the five columns); what the model doesn't know is 0.

        pairs: the (object type, relation) pairs that occur, if the caller knows
        them; else they are read from the requests first. A request that is
        still open where recursion was cut off raises ResolutionTooDeep; with
        ``errors`` it has that code in a column ``error`` instead, and the
        others are answered. Requests on other relations are not concerned.
        ids: the requests' objects, if they are so few that scans may filter by
        them.
        """
        known = self.analysis.model.nodes()
        if pairs is None:
            names = requests.select("object_type", "relation").distinct()
            names = names.where(F.concat_ws("\x1f", "object_type", "relation").isin([f"{t}\x1f{r}" for t, r in known]))
            pairs = sorted((x[0], x[1]) for x in names.collect())  # no more than the model has relations
        tuples = self._facts(contextual)
        asked = {(t, r): requests.where((F.col("object_type") == t) & (F.col("relation") == r)).dropna(subset=REQUEST) for t, r in pairs if self.analysis.model.expr(t, r) is not None}
        none = [F.lit(None).cast("int").alias("error")] * errors
        if not asked:
            return requests.select("idx", F.lit(0).alias("allowed"), *none)
        demand, cut = self._demand(asked, tuples)
        forward = Forward(self.analysis, tuples, requests.select("subject_type", "subject_id").dropna(), True, self.max_depth, demand, ids=dict.fromkeys(self._local(list(asked)), ids) if ids else None)
        held = [forward.holding(t, r, rows).select("subject_type", "subject_id", F.lit(r).alias("relation"), F.lit(t).alias("object_type"), "object_id") for (t, r), rows in asked.items()]
        out = requests.select("idx", *REQUEST).join(union_of(held).withColumn("held", F.lit(1)), REQUEST, "left").withColumn("allowed", F.coalesce("held", F.lit(0)).cast("int"))
        cut |= forward.truncated
        if not cut:
            return out.select("idx", "allowed", *none)
        open_ = F.lit(False)
        for t, r in asked:
            of = (F.col("object_type") == t) & (F.col("relation") == r)
            if cut & self.analysis.subtracted((t, r)):
                open_ |= of  # what was cut off may also take away
            elif any(cut & set(g) for g in self.analysis.needed([(t, r)])):
                open_ |= of & (F.col("allowed") == 0)
        out = out.withColumn("open", F.coalesce(open_, F.lit(False)))
        if errors:
            return out.select("idx", F.when(F.col("open"), 0).otherwise(F.col("allowed")).alias("allowed"), F.when(F.col("open"), ResolutionTooDeep.code).alias("error"))
        if not out.where("open").isEmpty():
            raise ResolutionTooDeep(f"no answer within {self.max_depth} steps")
        return out.select("idx", "allowed")

    def check(self, subject_type: str, subject_id: str, relation: str, object_type: str, object_id: str, contextual=None) -> int:
        """1 or 0 for one request."""
        row = (1, subject_type, subject_id, relation, object_type, object_id)
        one = self.tuples.sparkSession.createDataFrame([row], "idx int, subject_type string, subject_id string, relation string, object_type string, object_id string")
        return self.check_bulk(one, contextual, [(object_type, relation)], ids=[object_id]).first()["allowed"]

    def objects_of(self, subjects: DataFrame, relation: str, object_type: str, contextual=None, few: list[str] | None = None) -> DataFrame:
        """(subject_type, subject_id, object_id) for many subjects at once. few: their ids, if scans should filter by them."""
        self._too_deep((object_type, relation))
        forward = Forward(self.analysis, self._facts(contextual), subjects, True, self.max_depth, few=few)
        return forward.value(object_type, relation) if few else forward.listed(object_type, relation)

    def list_objects(self, subject_type: str, subject_id: str, relation: str, object_type: str, limit: int | None = None, after: str | None = None, contextual=None) -> DataFrame:
        """(object_id, next_cursor): the objects on which a subject holds a relation, in order."""
        one = self.tuples.sparkSession.createDataFrame([(subject_type, subject_id)], "subject_type string, subject_id string")
        return page(self.objects_of(one, relation, object_type, contextual, [subject_id]), "object_id", limit, after)

    def subjects_of(self, object_type: str, relation: str, subject_type: str, objects: DataFrame | None = None, contextual=None) -> DataFrame:
        """(object_id, subject_id) for all objects of a type, or for those given (object_id), at once.

        subject_type may be ``type#relation``: then the subjects are usersets.
        The wildcard is listed as ``*``; who is covered by it alone is not.
        """
        self._too_deep((object_type, relation))
        kind, _, rel = subject_type.partition("#")
        held = Backward(self.analysis, self._facts(contextual), kind, rel, self.max_depth).value(object_type, relation, objects)
        return listed(held) if objects is None else listed(held).join(objects.select("object_id").distinct(), "object_id", "left_semi")

    def explain_plan(self, subjects: DataFrame, relation: str, object_type: str) -> str:
        """The physical plan that lists objects for the subjects, as text; a dry run, apart from rounds of recursion."""
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            self.objects_of(subjects, relation, object_type).explain("formatted")
        return out.getvalue()

    def list_subjects(self, object_type: str, object_id: str, relation: str, subject_type: str, limit: int | None = None, after: str | None = None, contextual=None) -> DataFrame:
        """(subject_id, next_cursor): the subjects that hold a relation on an object, the wildcard first."""
        one = self.tuples.sparkSession.createDataFrame([(object_id,)], "object_id string")
        return page(self.subjects_of(object_type, relation, subject_type, one, contextual), "subject_id", limit, after, wildcard_leads=True)
