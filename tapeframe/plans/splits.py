"""Registered split, label and audit queries with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeframe.operators import features as feat
from tapeframe.operators import intervals, labels, packed, sealed, tape
from tapeframe.operators import splits as ops
from tapeframe.plans.duck import ARRIVALS, QUOTES, TRADES
from tapeframe.session import inline_table
from tapeframe.sources import views

HOUR = 3600 * 10**9
LABEL_NS = 5 * HOUR
PURGE = ops.PurgeConfig(purge_horizon_ns=LABEL_NS, embargo_ns=7 * HOUR)
BAR_NS = 12 * HOUR
UP, DOWN = 0.35, 0.25


def _samples(spark, sf):
    """Trades on an hourly clock, so many samples share a timestamp."""
    return views.trades(spark, sf).selectExpr(
        f"source_timestamp_ns div {HOUR}L * {HOUR}L ts", "sequence_num row_id", "price"
    )


def time_rank(spark, sf):
    return ops.with_time_rank(_samples(spark, sf), ["ts", "row_id"]).select("row_id", "row_index")


def holdout_split(spark, sf):
    return ops.holdout(_samples(spark, sf), "ts", "row_id", horizon=LABEL_NS).select(
        "row_id", "ts", "partition", "role"
    )


def _walk(spark, sf, expanding):
    df = _samples(spark, sf)
    n = ops.TimeAxis(df, "ts", "row_id").total
    return ops.walk_forward(df, "ts", "row_id", 4, n // 5, n // 10, expanding, LABEL_NS)


def walk_forward_rolling(spark, sf):
    return _walk(spark, sf, False).select("split_index", "row_id", "role")


def walk_forward_expanding(spark, sf):
    return _walk(spark, sf, True).select("split_index", "row_id", "role")


def purged_k_fold(spark, sf):
    df = ops.purged_k_fold(_samples(spark, sf), "ts", "row_id", 5, LABEL_NS, PURGE)
    return df.select("split_index", "row_id", "role")


def purge_embargo_counts(spark, sf):
    return ops.split_counts(
        ops.purged_k_fold(_samples(spark, sf), "ts", "row_id", 5, LABEL_NS, PURGE)
    )


def combinatorial_purged(spark, sf):
    df = ops.combinatorial_purged(_samples(spark, sf), "ts", "row_id", 6, 2, LABEL_NS, PURGE)
    return df.select("split_index", "row_id", "role")


def _packed(spark, sf):
    df = _samples(spark, sf)
    blocks = ops.contiguous_blocks(ops.TimeAxis(df, "ts", "row_id"), 6)
    folds = ops.combinatorial_folds(blocks, 2)
    return packed.packed_membership(df, "ts", blocks, folds, LABEL_NS, PURGE), len(folds)


def combinatorial_partition_rows(spark, sf):
    """The training rows of one combinatorial fold, out of packed roles."""
    rows, n = _packed(spark, sf)
    return packed.take_packed(rows, n, 7, "train").select("row_id", "ts", "price")


def combinatorial_counts(spark, sf):
    """Rows per combinatorial fold and role, counted on packed roles."""
    return packed.packed_counts(*_packed(spark, sf))


def split_partition_rows(spark, sf):
    df = ops.purged_k_fold(_samples(spark, sf), "ts", "row_id", 5, LABEL_NS, PURGE)
    return ops.take_partition(df, 2, "train").select("row_id", "ts", "price")


def label_interval_overlap(spark, sf):
    df = ops.with_label_interval(_samples(spark, sf), "ts", LABEL_NS)
    axis = ops.TimeAxis(df, "ts", "row_id")
    blocks = ops.fold_table(
        spark, [ops.Fold(i, (b,), None, None) for i, b in enumerate(ops.contiguous_blocks(axis, 5))]
    )
    return intervals.overlap_join(df, blocks, "ts", "label_end_ns").select("row_id", "split_index")


def interval_predicates(spark, sf):
    lo, hi = F.col("ts"), F.col("ts") + LABEL_NS
    a, b = F.lit(1705000000000000000), F.lit(1705500000000000000)
    return _samples(spark, sf).select(
        "row_id",
        intervals.contains(lo, a, b).alias("is_contained"),
        intervals.overlaps_half_open(lo, hi, a, b).alias("overlaps_half_open"),
        intervals.overlaps_closed(lo, hi, a, b).alias("overlaps_closed"),
        intervals.touches(lo, hi, a, b).alias("touches_partition"),
    )


def label_intervals(spark, sf):
    df = _samples(spark, sf).withColumn("horizon", (F.col("row_id") % 9 - 1) * HOUR)
    return ops.with_label_interval(df, "ts", "horizon").select(
        "row_id", "label_end_ns", "is_bad_horizon"
    )


def split_compliance(spark, sf):
    """Audit of folds that were cut without purging against the rules they should have met."""
    df = _samples(spark, sf)
    axis = ops.TimeAxis(df, "ts", "row_id")
    folds = [ops.Fold(i, (b,), None, None) for i, b in enumerate(ops.contiguous_blocks(axis, 5))]
    raw = ops.membership(df, "ts", "row_id", folds, 0, ops.PurgeConfig())
    raw = ops.with_label_interval(raw.drop("label_end_ns"), "ts", LABEL_NS)
    return ops.split_compliance(raw, ops.fold_table(spark, folds), "row_id", "ts", PURGE)


def membership_overlap(spark, sf):
    df = ops.purged_k_fold(_samples(spark, sf), "ts", "row_id", 5, LABEL_NS, PURGE)
    return ops.overlap_rows(
        ops.take_partition(df, 0, "train"), ops.take_partition(df, 1, "train"), "row_id"
    )


def duplicate_membership(spark, sf):
    orders = views.table(spark, sf, "lineitem").selectExpr("l_orderkey * 8 + l_linenumber row_id")
    return ops.duplicate_rows(orders, "row_id")


def point_in_time_audit(spark, sf):
    df = views.arrivals(spark, sf).withColumn(
        "decision_ns", F.expr("receive_timestamp_ns + (input_index % 7 - 1) * 1000")
    )
    return ops.point_in_time_audit(
        df, "source_timestamp_ns", "receive_timestamp_ns", "decision_ns"
    ).select("input_index", "is_lookahead", "is_acausal")


def feature_target_correlation(spark, sf):
    q = feat.with_weighted_mid(feat.with_spread_mid(feat.with_quote_validity(views.quotes(spark, sf))))
    q = q.withColumns({"flat": F.lit(1.0), "copy": F.col("mid_price") * 2,
                       "depth": F.expr("cast(best_bid_quantity as double)")})
    out = ops.feature_target_correlation(
        q, ["book_imbalance_top", "relative_spread", "depth", "flat", "copy"], "mid_price"
    )
    return out.withColumn("correlation", F.round("correlation", 6))


def availability_latency(spark, sf):
    return ops.availability_latency(
        views.arrivals(spark, sf), "source_timestamp_ns", "receive_timestamp_ns", ["instrument_id"]
    )


def split_bounds(spark, sf):
    axis = ops.TimeAxis(_samples(spark, sf), "ts", "row_id")
    folds = [ops.Fold(i, (b,), None, None) for i, b in enumerate(ops.contiguous_blocks(axis, 5))]
    return ops.fold_table(spark, folds)


def split_manifest(spark, sf):
    df = _samples(spark, sf)
    axis = ops.TimeAxis(df, "ts", "row_id")
    folds = [ops.Fold(i, (b,), None, None) for i, b in enumerate(ops.contiguous_blocks(axis, 5))]
    m = ops.split_manifest(
        ops.fold_table(spark, folds), "purged_k_fold", "trades", "none", axis.total, PURGE
    )
    sealed = ops.verify_split_manifest(m)
    return sealed.select("split_type", "dataset_id", "total_records", "purge_horizon_ns", "embargo_ns", "is_sealed",
                         F.length("content_hash").alias("hash_length"), F.inline("folds"))


def _role_members(spark, sf):
    """Three unpurged train, validation and test splits with rows planted in two roles, and their blocks."""
    df = ops.with_label_interval(_samples(spark, sf), "ts", LABEL_NS)
    b = ops.contiguous_blocks(ops.TimeAxis(df, "ts", "row_id"), 5)
    cuts = [(k, b[k + 1].start, b[k + 2].start, b[k + 2].stop) for k in range(3)]
    own = ", ".join(
        f"if(ts < {end}L, named_struct('split_index', {k}L, 'role', if(ts < {val}L, 'train', if(ts < {test}L, 'validation', 'test'))), null)"
        for k, val, test, end in cuts)
    rows = df.withColumn("m", F.expr(f"explode(array_compact(array({own})))")).select(*df.columns, "m.*")
    planted = rows.withColumn("role", F.expr(
        "case when role = 'train' and row_id % 50 = 0 then 'validation' when role = 'train' and row_id % 90 = 1 then 'test'"
        " when role = 'validation' and row_id % 70 = 0 then 'test' end")).where("role is not null")
    blocks = inline_table(spark, "split_index long, role string, block_start long, block_stop long", [
        r for k, val, test, end in cuts for r in ((k, "validation", val, test), (k, "test", test, end))])
    return rows.unionByName(planted), blocks


def role_compliance(spark, sf):
    """Leaks between every two roles: rows in both, and labels that reach into a later role."""
    return sealed.role_audit(*_role_members(spark, sf), "row_id", "ts")


def role_duplicates(spark, sf):
    """Rows that a role holds more than once, where every hundredth row was appended again."""
    members, _ = _role_members(spark, sf)
    return sealed.repeated_in_role(members.unionByName(members.where("row_id % 100 = 0")), "row_id")


def _sealed(spark, sf):
    df = _samples(spark, sf)
    folds = [ops.Fold(i, (b,), None, None) for i, b in enumerate(ops.contiguous_blocks(ops.TimeAxis(df, "ts", "row_id"), 5))]
    d = tape.content_digest(df).first()
    return sealed.seal_split(
        ops.membership(df, "ts", "row_id", folds, LABEL_NS, PURGE), ops.fold_table(spark, folds), "ts", "purged_k_fold", "trades",
        f"{d.n_rows}:{d.digest_xor}:{d.digest_sum}", {"n_splits": 5, "label_horizon_ns": LABEL_NS}, PURGE)


def split_seal(spark, sf):
    """The sealed description of a purged split: settings, bounds, counts and the digest of its data."""
    return sealed.is_sealed(_sealed(spark, sf))


def sealed_partition_rows(spark, sf):
    """A training partition read back from the sealed bounds."""
    return sealed.read_partition(_samples(spark, sf), _sealed(spark, sf), 2, "train", LABEL_NS).select("row_id", "ts", "price")


def forward_return_labels(spark, sf):
    out = labels.forward_returns(
        views.trades(spark, sf).select("instrument_id", "sequence_num", "source_timestamp_ns", "price"),
        "source_timestamp_ns", "price", "sequence_num", BAR_NS,
    )
    return out.withColumn("forward_log_return", F.round("forward_log_return", 9))


def _barrier(spark, sf):
    return labels.triple_barrier(
        views.trades(spark, sf), "source_timestamp_ns", "price", "sequence_num", UP, DOWN, BAR_NS
    )


def triple_barrier_labels(spark, sf):
    return _barrier(spark, sf)


def label_distribution(spark, sf):
    return labels.label_distribution(_barrier(spark, sf))


# --- oracles -------------------------------------------------------------------------------------

_SAMPLES = TRADES + f""", samples as (
 select source_timestamp_ns // {HOUR} * {HOUR} ts, sequence_num row_id, price from trades),
ranked as (select *, row_number() over (order by ts, row_id) - 1 r, count(*) over () n from samples),
runs as (select ts, min(r) s, max(r) + 1 e from ranked group by ts)"""


def _cuts(targets: str) -> str:
    """``cuts(k, c)``: each nominal target (k, t) moved off a run of equal timestamps."""
    return f"""targets as ({targets}),
cuts as (
 select k, case when p.ts <> q.ts then t when g.e - t <= t - g.s then g.e else g.s end c
 from targets join ranked p on p.r = t - 1 join ranked q on q.r = t join runs g on g.ts = q.ts)"""


def _blocks(k: int) -> str:
    return _SAMPLES + ", " + _cuts(
        f"select k, cast(floor(k * ((select count(*) from samples)::double / {k})) as bigint) t"
        f" from range(1, {k}) x(k)"
    ) + f""", edges as (select 0 k, 0 c union all select k, c from cuts
 union all select {k}, (select count(*) from samples)),
blocks as (
 select a.k block, a.c start_row, b.c stop_row, p.ts block_start, q.ts + 1 block_stop
 from edges a join edges b on b.k = a.k + 1 join ranked p on p.r = a.c
 join ranked q on q.r = b.c - 1)"""


_KFOLD = _blocks(5) + f""", members as (
 select block split_index, row_id, ts, price,
  case when ts >= block_start and ts < block_stop then 'test'
   when ts < block_stop and ts + {LABEL_NS} >= block_start then 'purged'
   when ts >= block_stop and ts < block_stop + {PURGE.embargo_ns} then 'embargoed'
   else 'train' end as role from samples, blocks)"""


def _walk_sql(expanding: bool) -> str:
    first = "0" if expanding else "greatest(0, nominal - train)"
    return f"""with {_SAMPLES}, sizes as (select n // 5 train, n // 10 test, n from ranked limit 1),
nominals as (select i, n - (3 - i) * test stop_nom, n - (3 - i) * test - test nominal, train, n
 from sizes, range(0, 4) x(i)),
{_cuts('''select i k, nominal t from nominals union all
 select i + 10, stop_nom from nominals where stop_nom < nominals.n''')},
folds as (
 select i, {first} first_row, a.c start_row, coalesce(b.c, nominals.n) stop_row, p.ts block_start,
  q.ts + 1 block_stop
 from nominals join cuts a on a.k = i left join cuts b on b.k = i + 10
 join ranked p on p.r = a.c join ranked q on q.r = coalesce(b.c, nominals.n) - 1)
select i split_index, row_id, case when r >= start_row then 'test'
  when ts + {LABEL_NS} >= block_start then 'purged' else 'train' end as role
 from ranked join folds on r >= first_row and r < stop_row"""


_BARRIER = TRADES + f""", t as (
 select instrument_id i, sequence_num s, source_timestamp_ns ts, price::double price,
  row_number() over (partition by instrument_id order by source_timestamp_ns, sequence_num) rn
 from trades),
band as (
 select a.i, a.rn, min(b.rn) hit from t a join t b on a.i = b.i and b.rn > a.rn
  and b.ts < a.ts + {BAR_NS}
 where (b.price - a.price) / a.price >= {UP}::double
  or (b.price - a.price) / a.price <= -{DOWN}::double group by 1, 2),
vert as (
 select a.i, a.rn, v.rn vrn from t a asof join (
  select i, ts, min(rn) rn from t group by 1, 2) v on a.i = v.i and a.ts + {BAR_NS} <= v.ts),
ends as (select i, max(rn) last_rn from t group by 1),
labelled as (
 select a.*, h.ts hts, h.price hp, v.ts vts, v.price vp, e.ts ets, e.price ep from t a
 left join band on band.i = a.i and band.rn = a.rn left join t h on h.i = a.i and h.rn = band.hit
 left join vert on vert.i = a.i and vert.rn = a.rn left join t v on v.i = a.i and v.rn = vert.vrn
 join ends on ends.i = a.i join t e on e.i = a.i and e.rn = ends.last_rn),
barrier as (
 select i instrument_id, ts observation_timestamp_ns, s sequence_num, price current_price,
  coalesce(hts, vts, ets) exit_timestamp_ns,
  case when hts is not null then hp when vts is not null then vp else ep end exit_price,
  case when hts is not null then (hp - price) / price when vts is not null
   then (vp - price) / price end return_value,
  hts is not null and coalesce((hp - price) / price >= {UP}::double, false) hit_upper,
  hts is not null and coalesce((hp - price) / price < {UP}::double, false) hit_lower,
  hts is null and vts is not null hit_vertical, coalesce(hts, vts) is not null is_valid
 from labelled)"""

QUERIES = {
    f.__name__: f
    for f in (
        time_rank, holdout_split, walk_forward_rolling, walk_forward_expanding, purged_k_fold,
        purge_embargo_counts, combinatorial_purged, combinatorial_partition_rows, combinatorial_counts, split_partition_rows, label_interval_overlap,
        interval_predicates, label_intervals, split_compliance, membership_overlap,
        duplicate_membership, point_in_time_audit, feature_target_correlation,
        availability_latency, split_bounds, split_manifest, role_compliance, role_duplicates, split_seal,
        sealed_partition_rows, forward_return_labels, triple_barrier_labels, label_distribution,
    )
}

_COMBOS = f"""{_blocks(6)}, combos as (
 select a.block_start s1, a.block_stop e1, b.block_start s2, b.block_stop e2,
  row_number() over (order by a.block, b.block) - 1 split_index
 from blocks a join blocks b on a.block < b.block),
chosen as (
 select split_index, row_id, ts, price, case when ts >= s1 and ts < e1 or ts >= s2 and ts < e2 then 'test'
 when ts < e1 and ts + {LABEL_NS} >= s1 then 'purged'
 when ts >= e1 and ts < e1 + {PURGE.embargo_ns} then 'embargoed'
 when ts < e2 and ts + {LABEL_NS} >= s2 then 'purged'
 when ts >= e2 and ts < e2 + {PURGE.embargo_ns} then 'embargoed' else 'train' end as role
 from samples, combos)"""

_ROLES = _blocks(5) + f""", cut as (
 select v.block - 1 split_index, v.block_start v, t.block_start t, t.block_stop e from blocks v join blocks t on t.block = v.block + 1 where v.block between 1 and 3),
own as (
 select split_index, row_id, ts, v, t, e, case when ts < v then 'train' when ts < t then 'validation' else 'test' end as role
 from samples join cut on ts < e),
placed as (
 select * from own union all
 select split_index, row_id, ts, v, t, e, case when role = 'train' and row_id % 50 = 0 then 'validation'
   when role = 'train' and row_id % 90 = 1 then 'test' else 'test' end
 from own where (role = 'train' and (row_id % 50 = 0 or row_id % 90 = 1)) or (role = 'validation' and row_id % 70 = 0)),
pair as (select * from (values ('train', 'validation'), ('train', 'test'), ('validation', 'test')) p(earlier, later))"""

_SEALED = _KFOLD + f""", hashed as (
 select ('0x' || substr(md5(price::varchar || '|' || row_id::varchar || '|' || ts::varchar), 1, 15))::bigint h from samples),
digest as (select count(*) || ':' || bit_xor(h) || ':' || cast(sum(h % 1000003) as bigint) d from hashed),
per as (
 select split_index, count(*) filter (role = 'embargoed') embargoed, count(*) filter (role = 'purged') purged,
  count(*) filter (role = 'test') test, count(*) filter (role = 'train') train, min(ts) filter (role = 'train') a,
  max(ts) filter (role = 'train') + 1 b from members group by 1),
sealed as (
 select '{{"config":{{"embargo_ns":{PURGE.embargo_ns},"label_horizon_ns":{LABEL_NS},"n_splits":5,"purge_horizon_ns":{PURGE.purge_horizon_ns},'
  || '"timestamp_column":"ts"}},"dataset_hash":"' || (select d from digest) || '","dataset_id":"trades","spec_version":"1.0.0",'
  || '"split_type":"purged_k_fold","splits":[' || string_agg('{{"embargoed_rows":' || embargoed || ',"purged_rows":' || purged
  || ',"split_index":' || split_index || ',"test":[{{"start":' || block_start || ',"stop":' || block_stop || '}}],"test_rows":' || test
  || ',"train_rows":' || train || ',"train_start":' || a || ',"train_stop":' || b || '}}', ',' order by split_index)
  || '],"time_start":' || (select min(ts) from samples) || ',"time_stop":' || (select max(ts) + 1 from samples) || '}}' as body
 from per join blocks on block = split_index)"""

_B0, _B1 = 1705000000000000000, 1705500000000000000

ORACLES = {
    "time_rank": f"with {_SAMPLES} select row_id, r row_index from ranked",
    "holdout_split": f"with {_SAMPLES}, " + _cuts(
        "select 1 k, cast(floor(n * 0.7::double) as bigint) t from (select distinct n from ranked)"
        " union all select 2, cast(floor(n * (0.7::double + 0.15::double)) as bigint)"
        " from (select distinct n from ranked)"
    ) + f""", b as (select max(ts) filter (k = 1) c1, max(ts) filter (k = 2) c2
 from cuts join ranked on r = c),
p as (select row_id, ts, case when ts < c1 then 'train' when ts < c2 then 'validation'
  else 'test' end as partition, ts + {LABEL_NS} le, c1, c2 from samples, b)
select row_id, ts, partition, case when (ts < c1 and le >= c1)
 or (ts >= c1 and ts < c2 and le >= c2) then 'purged' else partition end as role from p""",
    "walk_forward_rolling": _walk_sql(False),
    "walk_forward_expanding": _walk_sql(True),
    "purged_k_fold": f"with {_KFOLD} select split_index, row_id, role from members",
    "purge_embargo_counts": f"""with {_KFOLD} select split_index,
 count(*) filter (role = 'train') train_rows, count(*) filter (role = 'test') test_rows,
 count(*) filter (role = 'purged') purged_rows, count(*) filter (role = 'embargoed')
 embargoed_rows from members group by 1""",
    "combinatorial_purged": f"with {_COMBOS} select split_index, row_id, role from chosen",
    "combinatorial_partition_rows": f"with {_COMBOS} select row_id, ts, price from chosen where split_index = 7 and role = 'train'",
    "combinatorial_counts": f"""with {_COMBOS} select split_index, count(*) filter (role = 'train') train_rows,
 count(*) filter (role = 'test') test_rows, count(*) filter (role = 'purged') purged_rows,
 count(*) filter (role = 'embargoed') embargoed_rows from chosen group by 1""",
    "split_partition_rows": f"with {_KFOLD} select row_id, ts, price from members"
    " where split_index = 2 and role = 'train'",
    "label_interval_overlap": f"with {_blocks(5)} select row_id, block split_index from samples"
    f" join blocks on ts < block_stop and ts + {LABEL_NS} >= block_start",
    "interval_predicates": f"""with {_SAMPLES} select row_id, ts >= {_B0} and ts < {_B1}
 is_contained, ts < {_B1} and {_B0} < ts + {LABEL_NS} overlaps_half_open,
 ts <= {_B1} and {_B0} <= ts + {LABEL_NS} overlaps_closed,
 ts < {_B1} and ts + {LABEL_NS} >= {_B0} touches_partition from samples""",
    "label_intervals": f"""with {_SAMPLES} select row_id,
 case when row_id % 9 >= 1 then ts + (row_id % 9 - 1) * {HOUR} end label_end_ns,
 row_id % 9 < 1 is_bad_horizon from samples""",
    "split_manifest": f"""with {_blocks(5)} select 'purged_k_fold' split_type, 'trades' dataset_id,
 (select count(*) from samples) total_records, {PURGE.purge_horizon_ns} purge_horizon_ns, {PURGE.embargo_ns} embargo_ns,
 true is_sealed, 64 hash_length, block split_index, cast(0 as bigint) test_position, start_row, stop_row, block_start,
 block_stop from blocks""",
    "role_compliance": f"""with {_ROLES}, twofold as (
 select a.split_index, earlier, later, count(distinct a.row_id) in_both from pair join placed a on a.role = earlier
 join placed b on b.role = later and b.split_index = a.split_index and b.row_id = a.row_id group by 1, 2, 3),
leak as (
 select split_index, earlier, later, count(*) label_leaks from placed join pair on role = earlier
 where ts < case later when 'validation' then t else e end and ts + {LABEL_NS} >= case later when 'validation' then v else t end
 group by 1, 2, 3)
select coalesce(twofold.split_index, leak.split_index) split_index, coalesce(twofold.earlier, leak.earlier) earlier,
 coalesce(twofold.later, leak.later) later, coalesce(in_both, 0) in_both, coalesce(label_leaks, 0) label_leaks
from twofold full join leak on twofold.split_index = leak.split_index and twofold.earlier = leak.earlier
 and twofold.later = leak.later""",
    "role_duplicates": f"""with {_ROLES}, twice as (select split_index, role, row_id, count(*) n from (
  select * from placed union all select * from placed where row_id % 100 = 0) group by 1, 2, 3 having count(*) > 1)
select split_index, role, count(*) n_rows from twice group by 1, 2""",
    "split_seal": f"with {_SEALED} select body, sha256(body) content_hash, true is_sealed from sealed",
    "sealed_partition_rows": f"with {_KFOLD} select row_id, ts, price from members where split_index = 2 and role = 'train'",
    "split_bounds": f"with {_blocks(5)} select block split_index, cast(0 as bigint) test_position,"
    " start_row, stop_row, block_start, block_stop from blocks",
    "split_compliance": f"""with {_blocks(5)}, m as (
 select block split_index, row_id, ts, block_start, block_stop,
  ts >= block_start and ts < block_stop is_test from samples, blocks)
select split_index, cast(0 as bigint) in_both, cast(0 as bigint) duplicate_train,
 cast(0 as bigint) duplicate_test,
 count(*) filter (not is_test and ts < block_stop and ts + {LABEL_NS} >= block_start) unpurged,
 count(*) filter (not is_test and ts >= block_stop and ts < block_stop + {PURGE.embargo_ns})
 unembargoed from m group by 1""",
    "membership_overlap": f"""with {_KFOLD} select row_id from members where split_index = 0
 and role = 'train' intersect select row_id from members where split_index = 1
 and role = 'train'""",
    "duplicate_membership": "select l_orderkey * 8 + l_linenumber row_id, count(*) copies"
    " from lineitem group by 1 having count(*) > 1",
    "point_in_time_audit": f"""with {ARRIVALS} select input_index,
 receive_timestamp_ns > receive_timestamp_ns + (input_index % 7 - 1) * 1000 is_lookahead,
 source_timestamp_ns > receive_timestamp_ns is_acausal from arrivals
 where input_index % 7 - 1 < 0 or source_timestamp_ns > receive_timestamp_ns""",
    "feature_target_correlation": f"""with {QUOTES}, v as (
 select (best_bid_price + best_ask_price) / 2.0::double mid,
  (best_bid_quantity - best_ask_quantity)::double / (best_bid_quantity + best_ask_quantity) imb,
  (best_ask_price - best_bid_price) / ((best_bid_price + best_ask_price) / 2.0::double) rel,
  best_bid_quantity::double depth from quotes where best_bid_price < best_ask_price
  and best_bid_price > 0 and best_bid_quantity > 0 and best_ask_quantity > 0),
c as (select corr(imb, mid) a, corr(rel, mid) b, corr(depth, mid) d from v)
select unnest(['book_imbalance_top', 'relative_spread', 'depth', 'flat', 'copy']) feature,
 unnest([round(a, 6), round(b, 6), round(d, 6), 0.0::double, 1.0::double]) correlation,
 unnest([abs(a) > 0.999, abs(b) > 0.999, abs(d) > 0.999, false, true]) is_suspicious from c""",
    "availability_latency": f"""with {ARRIVALS}, l as (select instrument_id,
 receive_timestamp_ns - source_timestamp_ns lat from arrivals)
select instrument_id, count(*) n_rows, min(lat) min_latency_ns, max(lat) max_latency_ns,
 cast(sum(lat) as bigint) total_latency_ns, count(*) filter (lat < 0) negative_latency
 from l group by 1""",
    "forward_return_labels": f"""with {TRADES}, t as (
 select instrument_id, sequence_num, source_timestamp_ns, price from trades),
f as (select instrument_id i, source_timestamp_ns ts, arg_min(price, sequence_num)::double p
 from t group by 1, 2),
j as (select t.*, f.ts fts, f.p fp from t asof left join f on t.instrument_id = f.i
 and t.source_timestamp_ns + {BAR_NS} <= f.ts)
select instrument_id, sequence_num, source_timestamp_ns, price,
 coalesce(fts, source_timestamp_ns + {BAR_NS}) forward_timestamp_ns, fp forward_price,
 (fp - price::double) / price::double forward_return,
 round(ln(fp / price::double), 9) forward_log_return, fp is not null has_forward_target,
 coalesce(fts, source_timestamp_ns + {BAR_NS}) label_end_ns from j""",
    "triple_barrier_labels": f"with {_BARRIER} select * from barrier",
    "label_distribution": f"""with {_BARRIER} select instrument_id,
 case when hit_upper then 'upper' when hit_lower then 'lower' when hit_vertical then 'vertical'
  else 'censored' end outcome, count(*) n_labels from barrier group by 1, 2""",
}
