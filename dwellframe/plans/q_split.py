"""Split, fold, held-out and set-invariant queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import split as SP
from ..sources.views import cte
from .common import v
from .registry import query

SEED, TEST_SIZE, K = 42, 0.2, 5
RANKED = [("ranked", f"""select patient_id,
  row_number() over (order by md5(concat(cast(patient_id as varchar(20)), ':{SEED}')), patient_id) as rn,
  count(*) over () as n from cohort""")]
IS_TEST = f"rn <= ceil(n * {TEST_SIZE}e0)"


def _split(spark, sf):
    return SP.seeded_split(v(spark, sf, "cohort"), "patient_id", TEST_SIZE, SEED)


@query("seeded_split", covers=("E1", "F6"), sql=cte("cohort", extra=RANKED) + f"""
select patient_id, case when {IS_TEST} then 'test' else 'train' end as split from ranked""")
def seeded_split(spark, sf):
    s = _split(spark, sf)
    return (s.test.select("patient_id", F.lit("test").alias("split"))
            .unionByName(s.train.select("patient_id", F.lit("train").alias("split"))))


@query("heldout_ids", covers=("F6",), sql=cte("cohort", extra=RANKED) + f"""
select cast(patient_id as varchar) as patient_id from ranked where {IS_TEST}""")
def heldout_ids(spark, sf):
    return _split(spark, sf).test_ids("patient_id")


@query("tail_split", covers=("E2",), sql=cte("cohort") + f"""
select patient_id, case when rn > n - ceil(n * {TEST_SIZE}e0) then 'test' else 'train' end as split
from (select patient_id, row_number() over (order by patient_id) as rn, count(*) over () as n from cohort) t""")
def tail_split(spark, sf):
    s = SP.seeded_split(v(spark, sf, "cohort"), "patient_id", TEST_SIZE, SEED, shuffle=False,
                        order_col="patient_id")
    return (s.test.select("patient_id", F.lit("test").alias("split"))
            .unionByName(s.train.select("patient_id", F.lit("train").alias("split"))))


TIED = "select case when patient_id % 3 = 0 then null else patient_id % 40 end as k, modality, 1 as one from cohort"


@query("split_tied_keys", covers=("E1", "E2"), sql=cte("cohort", extra=[("tied", TIED)]) + f"""
, sides as (select seed, cast(count(*) as bigint) as n, cast(ceil(count(*) * {TEST_SIZE}e0) as bigint) as n_test from tied, (values (1), (2), (3)) s(seed) group by seed)
select concat('seed ', seed) as "case", cast(null as varchar) as modality, n, n_test from sides
union all
select 'tail', modality, cast(count(*) as bigint), cast(count(case when rn > total - ceil(total * 0.1e0) then 1 end) as bigint)
from (select modality, row_number() over (order by modality nulls first) as rn, count(*) over () as total from tied) t group by modality
union all
select 'tail of one value', cast(null as varchar), count(*), cast(ceil(count(*) * 0.1e0) as bigint) from tied""")
def split_tied_keys(spark, sf):
    """Exact sizes where keys are missing or repeat: seeded splits, a tail by a column of few values, and one of a single value."""
    tied = v(spark, sf, "cohort").select(F.when(F.col("patient_id") % 3 != 0, F.col("patient_id") % 40).alias("k"), "modality", F.lit(1).alias("one")).persist()
    parts = []
    for seed in (1, 2, 3):
        s = SP.seeded_split(tied, "k", TEST_SIZE, seed)
        parts.append((f"seed {seed}", None, s.train, s.test))
    tail = SP.tail_split(tied, "modality", 0.1)
    parts += [("tail", "modality", tail.train, tail.test)]
    same = SP.tail_split(tied, "one", 0.1)
    parts += [("tail of one value", None, same.train, same.test)]
    out = None
    for case, group, train, test in parts:
        rows = train.withColumn("t", F.lit(0)).unionByName(test.withColumn("t", F.lit(1)))
        one = rows.groupBy((F.col(group) if group else F.lit(None).cast("string")).alias("modality")).agg(F.count(F.lit(1)).alias("n"), F.sum("t").cast("bigint").alias("n_test")).select(F.lit(case).alias("case"), "modality", "n", "n_test")
        out = one if out is None else out.unionByName(one)
    return out


@query("folds", covers=("E3",), sql=cte("cohort") + f"""
select patient_id, cast(ntile({K}) over (order by md5(concat(cast(patient_id as varchar(20)), ':{SEED}')), patient_id) - 1
  as integer) as fold from cohort""")
def folds(spark, sf):
    return SP.assign_folds(v(spark, sf, "cohort"), K, "patient_id", SEED).select("patient_id", "fold")


@query("heldout_anti", covers=("C6",), sql=cte("cohort", extra=RANKED) + f"""
select c.patient_id, c.modality from cohort c join ranked r on c.patient_id = r.patient_id where not ({IS_TEST})""")
def heldout_anti(spark, sf):
    coh = v(spark, sf, "cohort")
    ids = _split(spark, sf).test_ids("patient_id").select(F.col("patient_id").cast("bigint").alias("patient_id"))
    return SP.heldout_anti(coh, ids).select("patient_id", "modality")


@query("split_set_checks", covers=("G1", "G3", "G4"), sql=cte("cohort", extra=RANKED) + f"""
select 'n_total' as "check", count(*) as n from ranked
union all select 'n_train', count(case when not ({IS_TEST}) then 1 end) from ranked
union all select 'n_test', count(case when {IS_TEST} then 1 end) from ranked
union all select 'n_overlap', cast(0 as bigint)
union all select 'n_union', count(distinct patient_id) from ranked
union all select 'n_uncovered', cast(0 as bigint)""")
def split_set_checks(spark, sf):
    """train ∪ test = all (union), train ∩ test = ∅ (intersect), all − (train ∪ test) = ∅ (exceptAll),
    as a long (check, n) table."""
    coh = v(spark, sf, "cohort").select("patient_id")
    s = SP.seeded_split(coh, "patient_id", TEST_SIZE, SEED)
    tr, te = s.train.select("patient_id"), s.test.select("patient_id")
    union = tr.union(te)
    parts = [("n_total", coh), ("n_train", tr), ("n_test", te), ("n_overlap", tr.intersect(te)),
             ("n_union", union.distinct()), ("n_uncovered", coh.exceptAll(union))]
    out = None
    for name, frame in parts:
        one = frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out
