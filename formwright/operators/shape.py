"""The shaper: a spec compiled to one plan over numbered records."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column as Col
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formwright.errors import DriftError, RecordError
from formwright.functions import typed
from formwright.functions import values as V
from formwright.operators import drift as D
from formwright.operators.infer import infer_columns
from formwright.plans.fence import fenced
from formwright.plans.spec import TYPES, Column, Spec, effective
from formwright.sources.lines import Records, fits, framed, sample, unframed


@dataclass
class Report:
    rows_in: int
    rows_out: int
    rejected: int
    parse_errors: int
    drift: D.Report

    def line(self, row_groups: int = 0, size: int = 0) -> str:
        return f"rows_in={self.rows_in} rows_out={self.rows_out} rejected={self.rejected} parse_errors={self.parse_errors} row_groups={row_groups} bytes={size}"


def schema_of(columns: tuple[Column, ...], spec: Spec) -> T.StructType:
    fields = [T.StructField(c.name, TYPES[c.type], not c.required) for c in columns]
    if spec.drift.policy == "rescue":
        fields.append(T.StructField(spec.drift.rescue_column, T.StringType(), True))
    return T.StructType(fields)


def _cells(c: Column, x: V.Value) -> tuple[Col, Col]:
    """(value, is missing or null)."""
    absent = x.kind == V.NULL
    if c.transform:
        x = V.TRANSFORMS[c.transform](x)
        absent = absent | (x.kind == V.NULL)
    if c.type == "string" and c.transform not in ("json_encode", "to_string"):
        x = V.replace(x, text=F.lit(None).cast("string"))
    return V.COERCIONS[c.type](x), absent


class Shaped:
    """One run of a spec over records. Everything is lazy but for report() and check()."""

    def __init__(self, spec: Spec, records: Records, columns: tuple[Column, ...] | None = None):
        self.spec, self.records = spec, records
        if columns is None:
            inferred = infer_columns(sample(records, spec.infer_sample), spec.flatten) if spec.mode == "infer" else ()
            columns = effective(spec, inferred)
        self.columns = columns
        self.schema = schema_of(columns, spec)
        self.watching = spec.drift.policy != "ignore"
        self.tree = D.covered(columns) if self.watching else None

    @cached_property
    def everything(self) -> DataFrame:
        """(seq, raw, fits, ok, c0.., fatal, reason, new, misfits): every line that is not blank, and if it is a record, its fate.

        A typed parse of the declared columns reads what it can; only records that it is not sure of become variants.
        """
        spec = self.spec
        own = typed.schema(self.columns) if self.columns else None
        keys = D.object_keys(self.tree) if self.watching and own is not None else None
        n = range(len(self.columns))
        lines = self.records.lines.select("seq", "raw", fits(F.col("raw"), self.records.most_bytes).alias("fits"))
        if own is None or (self.watching and keys is None):
            df = lines.withColumn("fast", F.lit(False))
            quick: list[str] = []
        else:
            df = lines.withColumn("f", typed.parse(F.col("raw"), F.col("fits"), own))
            df = df.select("seq", "raw", "fits", typed.whole(F.col("f")).alias("whole"), *(typed.at(F.col("f"), c).alias(f"x{i}") for i, c in enumerate(self.columns)), *(k(F.when(typed.whole(F.col("f")), F.col("raw"))).alias(f"k{j}") for j, (k, _) in enumerate(keys or ())))
            df = df.select("*", *(typed.cell(c, F.col(f"x{i}")).alias(f"q{i}") for i, c in enumerate(self.columns)))
            sure = [typed.certain(c, F.col(f"x{i}"), F.col(f"q{i}")) for i, c in enumerate(self.columns)]
            # a repeated key may hide another's value from the keys that are looked at
            sure += [F.coalesce(F.size(F.array_distinct(f"k{j}")) == F.size(f"k{j}"), F.lit(True)) for j in range(len(keys or ()))]
            extra = reduce(lambda a, b: a | b, (F.coalesce(F.size(F.array_except(f"k{j}", names)) > 0, F.lit(False)) for j, (_, names) in enumerate(keys or ())), F.lit(False))
            quick = [f"q{i}" for i in n]
            df = df.select("seq", "raw", "fits", reduce(lambda a, b: a & b, sure, F.col("whole")).alias("fast"), extra.alias("extra"), *quick)
        # what is not fast is parsed as a variant; for all other records every step below sees nulls
        slow = F.when(~F.col("fast") & F.col("fits"), F.col("raw"))
        kept = ["seq", "raw", "fits", "fast", *(["extra"] if quick else []), *quick]
        df = fenced(df).select(*kept, *framed(slow)).select(*kept, *unframed())
        df = df.select(*kept, (F.col("fast") | (F.col("fits") & F.coalesce("w", F.lit(False)) & F.col("v").isNotNull())).alias("ok"), "v")
        # parts, then their schemas, then their kinds: each a projection that the next one reads more than once
        parts = df.select("*", *(V.get(F.col("v"), V.segments(c.path)).alias(f"p{i}") for i, c in enumerate(self.columns)))
        parts = parts.select("*", *(F.schema_of_variant(f"p{i}").alias(f"s{i}") for i in n))
        parts = parts.select("*", *(V.kind_of(F.col(f"p{i}"), F.col(f"s{i}")).alias(f"k{i}") for i in n))
        # then their values by kind, so that transforms and coercions refer to columns
        held = [V.value(F.col(f"p{i}"), F.col(f"k{i}"), F.col("raw"), V.segments(c.path), c.type in ("json", "string") or c.transform in ("json_encode", "to_string")) for i, c in enumerate(self.columns)]
        if self.columns:
            parts = parts.select(*kept, "ok", "v", *(f"p{i}" for i in n), *(f"k{i}" for i in n), *(x.alias(f"{name}{i}_") for i, h in enumerate(held) for name, x in h.parts().items()))
        cells: list[Col] = []
        for i, c in enumerate(self.columns):
            cell, absent = _cells(c, V.Value(F.col(f"k{i}"), **{name: F.col(f"{name}{i}_") for name in held[i].parts()}))
            if quick:
                cell, absent = F.when(F.col("fast"), F.col(f"q{i}")).otherwise(cell), F.when(F.col("fast"), F.col(f"q{i}").isNull()).otherwise(absent)
            cells += [cell.alias(f"c{i}"), F.coalesce(absent, F.lit(True)).alias(f"a{i}"), F.col(f"p{i}")]
        base = fenced(parts.select("seq", "raw", "fits", "fast", "ok", *(["extra"] if quick else []), "v", *cells))
        reason, misfits, stopped, fatal = F.lit(None).cast("string"), [], F.lit(False), F.lit(None).cast("string")
        for i, c in enumerate(self.columns):
            absent, failed = F.col(f"a{i}"), ~F.col(f"a{i}") & F.col(f"c{i}").isNull()
            text = F.to_json(F.when(failed, F.col(f"p{i}")))
            hint = "; use type json for nested values" if c.type == "string" else ""
            if c.required:
                why = F.when(absent, f"required column `{c.name}` is missing or null").when(failed, F.concat(F.lit(f"column `{c.name}`: cannot read "), text, F.lit(f" as {c.type}{hint}")))
                fatal = F.coalesce(fatal, why) if spec.mode == "strict" else fatal
                reason = F.coalesce(reason, why)
                stopped = stopped | absent | failed
            elif spec.mode == "strict":
                fatal = F.coalesce(fatal, F.when(~stopped & failed, F.concat(F.lit(f"column `{c.name}`: cannot read "), text, F.lit(f" as {c.type}{hint}"))))
            elif self.watching:
                misfits.append(F.when(~stopped & failed, F.struct(F.lit(c.name).alias("path"), F.lit(0).alias("seen"), text.alias("example"))))
        none = F.array().cast(D.EVENT)
        new = none
        if self.watching and self.tree is not None:
            more = D.may_drift(F.col("v"), self.tree)
            more = F.when(F.col("fast"), F.col("extra")).otherwise(more) if quick else more
            new = F.coalesce(D.events(self.tree, spec.flatten)(F.when(F.col("ok") & more, F.col("raw"))), none)
        found = F.coalesce(F.when(~F.col("fast"), F.filter(F.array(*misfits), lambda x: x.isNotNull())).cast(D.EVENT), none) if misfits else none
        real = lambda x: F.when(F.col("ok"), x)
        return fenced(base.select("seq", "raw", "fits", "ok", *(f"c{i}" for i in n), real(fatal).alias("fatal"), real(reason).alias("reason"), new.alias("new"), found.alias("misfits")))

    @property
    def judged(self) -> DataFrame:
        """(seq, raw, c0.., fatal, reason, new, misfits): every pushed record, with its fate."""
        return self.everything.where("ok").drop("fits", "ok")

    @cached_property
    def outcomes(self) -> DataFrame:
        """everything with the drift policy applied: a reason for every rejected record."""
        df = self.everything
        drifted = (F.size("new") > 0) | (F.size("misfits") > 0)
        df = df.withColumn("drifted", F.col("ok") & F.col("reason").isNull() & drifted)
        if self.spec.drift.policy == "quarantine":
            df = df.withColumn("reason", F.coalesce("reason", F.when(F.col("drifted"), self._drift_text())))
        return df

    @property
    def fates(self) -> DataFrame:
        """outcomes of the records alone."""
        return self.outcomes.where("ok").drop("fits", "ok")

    def counts(self) -> list[Col]:
        """What one pass over outcomes tells, in aggregates of a fixed size."""
        of = lambda c: F.count(F.when(c, 1))
        ok, out = F.col("ok"), F.col("reason").isNotNull()
        stop = self.spec.drift.policy == "error"
        drift = F.when(F.col("drifted"), self._drift_text()) if stop else F.lit(None).cast("string")
        first = F.min(F.when(F.col("fatal").isNotNull() | drift.isNotNull(), F.struct("seq", "fatal", drift.alias("drift"))))
        return [of(ok).alias("n"), of(ok & out).alias("rejected"), of(F.col("drifted")).alias("drifted"), of(~ok).alias("bad"), first.alias("stop")]

    def told(self, c) -> None:
        """Raise for the first record that stops the run, if counts found one."""
        if c["stop"] is None:
            return
        seq, fatal, drift = c["stop"]
        number = self.record_numbers([seq])[seq]
        raise RecordError(f"record {number}: {fatal}") if fatal is not None else DriftError(f"record {number}: {drift}")

    @staticmethod
    def _drift_text() -> Col:
        first = F.when(F.size("new") > 0, F.concat(F.lit("new field `"), F.try_element_at("new", F.lit(1))["path"], F.lit("`"))).otherwise(F.concat(F.lit("type mismatch in column `"), F.try_element_at("misfits", F.lit(1))["path"], F.lit("`")))
        return F.concat(F.lit("schema drift: "), first)

    @property
    def rows(self) -> DataFrame:
        """The shaped rows, with seq as their last column."""
        return self.shaped(self.outcomes)

    def shaped(self, outcomes: DataFrame) -> DataFrame:
        df = outcomes.where("ok and reason is null")
        out = [F.col(f"c{i}").cast(TYPES[c.type]).alias(c.name) for i, c in enumerate(self.columns)]
        if self.spec.drift.policy == "rescue":
            text = D.rescued(self.tree, self.spec.flatten)
            out.append(F.when(F.col("drifted"), text(F.when(F.col("drifted"), F.col("raw")), F.col("misfits"))).alias(self.spec.drift.rescue_column))
        return df.select(*out, F.col("seq").alias("__seq"))

    @property
    def table(self) -> DataFrame:
        """The shaped rows."""
        return self.rows.drop("__seq")

    @property
    def rejects(self) -> DataFrame:
        """Shaped-out rows as JSON text of {error, raw}, and malformed ones as {line, error, raw}."""
        out = self.fates.where("reason is not null").select(F.concat(F.lit('{"error":'), _quoted("reason"), F.lit(',"raw":'), F.col("raw"), F.lit("}")).alias("value"), "seq")
        bad = self.records.bad.select(F.to_json(F.struct("line", "error", "raw")).alias("value"), F.col("line").alias("seq"))
        return out.unionAll(bad)

    def check(self) -> None:
        """Strict mode, and the policy ``error``: raise for the first record that stops the run. Nothing is written before."""
        if self.spec.mode == "strict" or self.spec.drift.policy == "error":
            self.told(self.outcomes.agg(*self.counts()).first())

    def record_numbers(self, seqs: list[int]) -> dict[int, int]:
        """1-based positions among the parsed records of records given by line; one pass, a bounded array per task."""
        if not seqs:
            return {}
        edges = np.array(sorted(seqs))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(edges) + 1, np.int64)
            for b in batches:
                total += np.bincount(np.searchsorted(edges, b.column(0).to_numpy()), minlength=len(edges) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(edges) + 1)), pa.array(total)], ["at", "n"])

        got = dict(self.records.good.select("seq").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n")).collect())
        return dict(zip(edges.tolist(), np.cumsum([got.get(i, 0) for i in range(len(edges))]).tolist(), strict=True))

    def report(self, counts=None) -> Report:
        """counts: those of a pass made already."""
        c = self.outcomes.agg(*self.counts()).first() if counts is None else counts
        policy = self.spec.drift.policy
        drift = D.report(self.judged.select("seq", "new", "misfits"), self.columns, self.spec.drift.max_examples, self.record_numbers) if self.watching and (c["drifted"] or c["rejected"]) else D.Report()
        drift.scanned, drift.rows_with_drift = (c["n"], c["drifted"]) if self.watching else (0, 0)
        drift.quarantined, drift.rescued = c["drifted"] if policy == "quarantine" else 0, c["drifted"] if policy == "rescue" else 0
        return Report(c["n"], c["n"] - c["rejected"], c["rejected"], c["bad"] + self.records.broken(), drift)


def _quoted(name: str) -> Col:
    """A string column as JSON text."""
    whole = F.to_json(F.struct(F.col(name).alias("e")))
    return F.regexp_replace(whole, r'^\{"e":|\}$', "")
