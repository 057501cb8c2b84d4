"""Queries of retrieval, contrastive scores, evaluation and schedules."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import clips, contrastive, evaluation, ordering, retrieval
from ..sources.scratch import materialize
from .base import ASSIGN_SQL, VIEWS_SQL, label_centers, table, vectors, views
from .registry import query

_TWO = "tw as (select 'a' \"view\", vec_id id, label from embeddings where vec_id % 3 <> 0 union all select 'b', vec_id, label from embeddings where vec_id % 4 <> 0 and label <> 9)"


def _two(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return e.where("id % 3 <> 0").withColumn("view", F.lit("a")).unionByName(e.where("id % 4 <> 0 and label <> 9").withColumn("view", F.lit("b")))


@query("class_clip", f"""with {_TWO}, g as (select "view", label, count(*) n from tw group by all), c as (select *, dense_rank() over (partition by "view" order by label) c from g),
  m as (select c, least(min(n), 20) m from c group by c having count(*) = 2),
  r as (select t."view", t.id, t.label, c.c, row_number() over (partition by t."view", t.label order by t.id) pos from tw t join c using ("view", label))
  select "view", id, label, r.c "class", pos from r join m on m.c = r.c where pos <= m""")
def class_clip(spark, d):
    return retrieval.clip_classes(_two(spark, d), 20)


@query("align_views", f"with {_TWO} select id from tw group by id having count(distinct \"view\") = 2")
def align_views(spark, d):
    return retrieval.aligned(_two(spark, d), 2)


def _derange(by, n):
    return f"""with p as (select vec_id id, label, row_number() over ({by} order by md5('{n}-' || vec_id), vec_id) pos, count(*) over ({by}) sz from embeddings),
  q as (select *, pos <= floor(sz * 0.5) same from p),
  r as (select *, lead(id) over (partition by {'label, ' if by else ''}same order by pos) nx, first_value(id) over (partition by {'label, ' if by else ''}same order by pos) fs from q)
  select id, case when same then id else coalesce(nx, fs) end partner, (case when same then id else coalesce(nx, fs) end) = id is_true from r"""


@query("derange_class", _derange("partition by label", 11))
def derange_class(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return retrieval.derange_within(e, 0.5, 11, ["label"]).select("id", "partner", "is_true")


@query("derange_sample", _derange("partition by label % 4", 12).replace("partition by label, same", "partition by label % 4, same"))
def derange_sample(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 4).alias("shard"))
    return retrieval.derange_within(e, 0.5, 12, ["shard"]).select("id", "partner", "is_true")


@query("start_one_per_class", "select label, min(vec_id) id from embeddings group by label")
def start_one_per_class(spark, d):
    return retrieval.start_per_class(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"))


_SIM = {
    "ip": "list_inner_product(va, vb)", "cs": "list_inner_product(va, vb) / sqrt(list_inner_product(va, va)) / sqrt(list_inner_product(vb, vb))",
    "l1": "-list_sum(list_transform(list_zip(va, vb), lambda z: abs(z[1] - z[2])))", "l2": "-list_sum(list_transform(list_zip(va, vb), lambda z: (z[1] - z[2]) * (z[1] - z[2])))",
}


def _distance(kind):
    sql = f"with {VIEWS_SQL}, s as (select id, {_SIM[kind]} score from vw) select id, round(score, 6) score from s order by round(score, 6) desc, id limit 100"

    def run(spark, d):
        return retrieval.by_similarity(views(spark, d), kind, 100).withColumn("score", F.round("score", 6))

    query(f"similarity_{kind}", sql)(run)


for _k in _SIM:
    _distance(_k)

def _runs_sql(run):
    return f"runs as (select {run} run, vec_id id, row_number() over (partition by {run} order by md5('5-' || vec_id), vec_id) pos, embedding[1]::double score from embeddings)"


def _runs(spark, d, run):
    e = table(spark, d, "embeddings").select(run.alias("run"), F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("score"))
    placed = ordering.numbered_by(e.withColumn("_draw", ordering.draw(5)), ["run"], ["_draw", "id"], "pos", "_size")
    return placed.select("run", "id", "score", (F.col("pos") + 1).alias("pos"))


def _run_queries(suffix, run, column):
    """Gains and prefix metrics of runs named by ``run``: by label, and of one run that holds all rows."""

    def gain_prev(spark, d):
        return retrieval.gain(_runs(spark, d, column())).select("run", "id", F.round("gain", 6).alias("gain"))

    def prf_prefix(spark, d):
        runs = _runs(spark, d, column())
        out = retrieval.prefix_metrics(runs.select("run", "pos", "id"), runs.where("id % 2 = 0").select("id"))
        return out.select("run", "pos", "id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])

    query(f"gain_prev{suffix}", f"with {_runs_sql(run)} select run, id, round(score + lag(score, 1, 0.0) over (partition by run order by pos), 6) gain from runs")(gain_prev)
    query(f"prf_prefix{suffix}", f"""with {_runs_sql(run)}, h as (select *, sum((id % 2 = 0)::int) over (partition by run order by pos) hits, count(*) over (partition by run order by pos) n, (select count(*) from embeddings where vec_id % 2 = 0) total from runs),
  p as (select run, pos, id, hits / n p, hits / total r from h) select run, pos, id, round(p, 6) "precision", round(r, 6) recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) f1 from p""")(prf_prefix)


_run_queries("", "label", lambda: F.col("label"))
_run_queries("_one_run", "0", lambda: F.lit(0))


@query("precision_recall", """with c as (select distinct doc_id id from labels where quality = 1), t as (select doc_id id from documents where n_chars > 1000),
  n as (select (select count(*) from c where id in (select id from t)) b, (select count(*) from c) c, (select count(*) from t) t)
  select round(b / c, 6) "precision", round(b / t, 6) recall, round(2 * (b / c) * (b / t) / (b / c + b / t), 6) f1 from n""")
def precision_recall(spark, d):
    chosen = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    truth = table(spark, d, "documents").where("n_chars > 1000").select(F.col("doc_id").alias("id"))
    return evaluation.precision_recall(chosen, truth).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _weights():
    i = np.arange(32)
    wa = ((i[:, None] * 7 + np.arange(4)[None] * 3) % 11 - 5) / 10
    return contrastive.Projection(wa, np.arange(4) / 10, wa[::-1].copy(), np.zeros(4))


_PROJ = VIEWS_SQL + """, pr as (select id, list_transform(generate_series(0, 3), lambda m: list_inner_product(va, list_transform(generate_series(0, 31), lambda i: ((i * 7 + m * 3) % 11 - 5) / 10::double)) + m / 10) pa,
  list_transform(generate_series(0, 3), lambda m: list_inner_product(vb, list_transform(generate_series(0, 31), lambda i: (((31 - i) * 7 + m * 3) % 11 - 5) / 10::double))) pb from vw)"""


@query("contrastive_score", f"with {_PROJ} select id, round(list_inner_product(pa, pb) / sqrt(list_inner_product(pa, pa)) / sqrt(list_inner_product(pb, pb)), 6) score from pr")
def contrastive_score(spark, d):
    return contrastive.score(views(spark, d), _weights()).select("id", F.round("score", 6).alias("score"))


@query("infonce_loss", f"""with {VIEWS_SQL}, n as (select *, (row_number() over (order by md5('0-' || id), id) - 1) // 128 batch from vw),
  s as (select batch, x.id a, y.id b, list_inner_product(x.va, y.vb) / sqrt(list_inner_product(x.va, x.va)) / sqrt(list_inner_product(y.vb, y.vb)) s from n x join n y using (batch)),
  za as (select batch, avg(z) z from (select batch, a, ln(sum(exp(s / 0.1))) z from s group by all) group by batch), zb as (select batch, avg(z) z from (select batch, b, ln(sum(exp(s / 0.1))) z from s group by all) group by batch),
  t as (select batch, avg(s / 0.1) t, count(*) n from s where a = b group by batch)
  select batch, n, round((za.z + zb.z) / 2 - t, 6) loss from za join zb using (batch) join t using (batch)""")
def infonce_loss(spark, d):
    return contrastive.batch_losses(contrastive.batched(views(spark, d), 128)).withColumn("loss", F.round("loss", 6))


@query("contrastive_train")
def contrastive_train(spark, d):
    rows = views(spark, d)
    p, _ = contrastive.train(rows, m=8, epochs=1)
    return contrastive.score(rows, p).select("id", "score")


_SCORES = """e as (select vec_id id, label, unnest(generate_series(0, 63)) pos, unnest(embedding)::double x from embeddings), c0 as (select label "class", pos, avg(x) c from e group by all),
  sc as (select id, any_value(label) label, "class", round(-sum((x - c) * (x - c)), 6) score from e join c0 using (pos) group by id, "class")"""


def _scores(spark, d):
    from ..functions.vectors import l2

    rows = vectors(spark, d)
    centers = materialize(label_centers(rows).select(F.col("k").alias("class"), "center"), "centers")  # one per label
    if centers.count() > 10_000:
        raise ValueError("more classes than a table of scores has columns for")
    return rows.crossJoin(F.broadcast(centers)).select("id", "label", "class", F.round(l2(F.col("vec"), F.col("center")), 6).alias("score"))


@query("topk_accuracy", f"""with {_SCORES}, r as (select id, label, "class", row_number() over (partition by id order by score desc, "class") rk from sc),
  t as (select rk from r where "class" = label) select round(avg((rk <= 1)::int * 100.0), 6) top1_acc, round(avg((rk <= 5)::int * 100.0), 6) top5_acc, round(avg((rk > 1)::int * 100.0), 6) top1_err, round(avg((rk > 5)::int * 100.0), 6) top5_err from t""")
def topk_accuracy(spark, d):
    out = evaluation.top_k_accuracy(_scores(spark, d))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def _ensemble(how, sql):
    def run(spark, d):
        s = _scores(spark, d).select(F.col("id").alias("clip"), F.lit(0).alias("view_order"), "class", (F.col("score") + 3).alias("score"))
        return evaluation.ensemble(s, 5, how).select("point", "class", F.round("score", 6).alias("score"))

    query(f"ensemble_{how}", f'with {_SCORES} select id // 5 point, "class", round({sql}, 6) score from (select id, "class", score + 3 score from sc) group by all')(run)


_ensemble("sum", "sum(score)")
_ensemble("max", "greatest(0, max(score))")


def _rolling(name, run, column):
    """Averages of values of two decimals end in a 5 now and then; what is added lets sums in any order round alike."""
    sql = f"""select {run} run, event_id step, round(median(value) over w, 8) win_median, round(avg(value) over w, 8) win_avg, round(avg(value) over (partition by {run} order by event_id) + 1e-10, 8) global_avg
  from events window w as (partition by {run} order by event_id rows between 9 preceding and current row)"""

    def rolling(spark, d):
        log = table(spark, d, "events").select(column().alias("run"), F.col("event_id").alias("step"), "value")
        out = evaluation.rolling(log, 10)
        return out.select("run", "step", F.round("win_median", 8).alias("win_median"), F.round("win_avg", 8).alias("win_avg"), F.round(F.col("global_avg") + 1e-10, 8).alias("global_avg"))

    query(name, sql)(rolling)


_rolling("win_median", "user_id", lambda: F.col("user_id"))
_rolling("win_median_one_series", "0", lambda: F.lit(0))


@query("epoch_avg", "select l_linenumber epoch, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) mean from lineitem group by 1")
def epoch_avg(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_linenumber", "epoch")
    return evaluation.weighted_epochs(li, "l_discount", "l_quantity").select("epoch", F.round("mean", 6).alias("mean"))


@query("eval_epochs", "select o_orderkey, ((o_orderkey + 1) % 10 = 0) or o_orderkey + 1 = 15000 is_eval from orders")
def eval_epochs(spark, d):
    return table(spark, d, "orders").select("o_orderkey", evaluation.eval_epoch(F.col("o_orderkey"), 10, 15000).alias("is_eval"))


@query("lr_schedule", """select c_custkey step, round(case when c_custkey < 200 then 0.0001 + (0.01 - 0.0001) * c_custkey / 200 else 0.01 end, 9) warm,
  round(0.01 * (cos(pi() * c_custkey / 1500) + 1.0) * 0.5, 9) cosine, round(case when c_custkey < 100 then c_custkey / 100 else greatest(0.0, (1500 - c_custkey) / 1400) end, 9) linear,
  round(pow(0.1, 2 + c_custkey // 5 % 4), 9) kmeans from customer""")
def lr_schedule(spark, d):
    s = F.col("c_custkey")
    return table(spark, d, "customer").select(
        s.alias("step"), F.round(numbers.warmup(s, 0.0001, 0.01, 200), 9).alias("warm"), F.round(numbers.cosine(s, 0.01, 1500), 9).alias("cosine"),
        F.round(numbers.linear_decay(s, 100, 1500), 9).alias("linear"), F.round(numbers.kmeans_step(s % 20), 9).alias("kmeans"),
    )


@query("batch_quota", "select l_orderkey, count(*) rows, ceil(count(*) * 4 / 20)::bigint quota from lineitem group by 1")
def batch_quota(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("rows"))
    return n.select("l_orderkey", "rows", numbers.quota(F.col("rows"), 4, 20).cast("bigint").alias("quota"))


@query("view_geometry", "select doc_id, (doc_id % 30) // 3 temporal, (doc_id % 30) % 3 spatial, round(greatest(n_chars - 500.0, 0.0) * ((doc_id % 30) // 3) / 9, 6) \"start\" from documents")
def view_geometry(spark, d):
    i = F.col("doc_id") % 30
    t, s = evaluation.spatial_view(i, 3)
    return table(spark, d, "documents").select("doc_id", t.alias("temporal"), s.alias("spatial"), F.round(evaluation.view_start(F.col("n_chars") - 500.0, t, 10), 6).alias("start"))


@query("json_lines", "select o_orderkey, o_orderpriority priority, round(o_totalprice / 7, 6) price from orders")
def json_lines(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), (F.col("o_totalprice") / 7).alias("price"))
    line = evaluation.json_line(o, ["o_orderkey", "priority", "price"])
    field = lambda name, kind: F.get_json_object("line", f"$.{name}").cast(kind).alias(name)
    return line.select(field("o_orderkey", "bigint"), field("priority", "string"), field("price", "double"))


_PAIRSIM = "cl as (select vec_id // 10 video, vec_id clip, embedding[1:32]::double[] v from embeddings)"


@query("clip_similarity", f"with {_PAIRSIM} select x.video, x.clip a, y.clip b, round(list_inner_product(x.v, y.v) / sqrt(list_inner_product(x.v, x.v)) / sqrt(list_inner_product(y.v, y.v)), 6) score from cl x join cl y on x.video = y.video and x.clip < y.clip")
def clip_similarity(spark, d):
    return _clip_pairs(spark, d, places=6)


def _clip_pairs(spark, d, video=None, places=None):
    from ..functions.vectors import cosine

    c = table(spark, d, "embeddings").select((F.floor(F.col("vec_id") / 10) if video is None else video).alias("video"), F.col("vec_id").alias("clip"), F.slice("embedding", 1, 32).alias("vec"))
    return clips.similar_pairs(c, cosine, places=places)


_ONE_VIDEO = _PAIRSIM.replace("vec_id // 10 video", "0::bigint video")


@query("clip_similarity_one_video", f"with {_ONE_VIDEO} select x.video, x.clip a, y.clip b, round(list_inner_product(x.v, y.v) / sqrt(list_inner_product(x.v, x.v)) / sqrt(list_inner_product(y.v, y.v)), 6) score from cl x join cl y on x.clip < y.clip")
def clip_similarity_one_video(spark, d):
    """One video holds all clips."""
    return _clip_pairs(spark, d, F.lit(0).cast("bigint"), 6)


@query("diversity_sample")
def diversity_sample(spark, d):
    return clips.diverse(_clip_pairs(spark, d), 3)


def _strategy(name):
    def run(spark, d):
        return clips.picked(_clip_pairs(spark, d), 3, name)

    query(f"diversity_{name}")(run)


for _k in clips.DIVERSITY:
    _strategy(_k)


@query("experiment_means", "select l_linestatus run, round(avg(l_discount), 6) l_discount, round(avg(l_tax), 6) l_tax from lineitem group by 1")
def experiment_means(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_linestatus", "run")
    return evaluation.experiment_means(li, "run", ["l_discount", "l_tax"]).select("run", *[F.round(c, 6).alias(c) for c in ("l_discount", "l_tax")])


@query("positives_ratio", "select vec_id // 20 batch, round(avg((vec_id in (select doc_id from labels where quality = 1))::int), 6) ratio from embeddings group by 1")
def positives_ratio(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 20).alias("batch"))
    truth = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return evaluation.positives_ratio(rows, truth).withColumn("ratio", F.round("ratio", 6))


@query("compared_runs", f"""with {_runs_sql("label")}, m as (select run, pos, id % 7 id, score from runs)
  select x.run "first", y.run "second", round(avg((x.id = y.id)::int), 6) same, round(avg(abs(x.score - y.score)), 6) gain_difference from m x join m y using (pos) where x.run < y.run group by all""")
def compared_runs(spark, d):
    runs = _runs(spark, d, F.col("label")).select("run", "pos", (F.col("id") % 7).alias("id"), F.col("score").alias("gain"))
    return evaluation.compared_runs(runs).select("first", "second", *[F.round(c, 6).alias(c) for c in ("same", "gain_difference")])


@query("mean_pool", "select vec_id, p::bigint pos, round((embedding[p + 1]::double + embedding[p + 17]::double + embedding[p + 33]::double + embedding[p + 49]::double) / 4, 6) x from embeddings, unnest(generate_series(0, 15)) u(p)")
def mean_pool(spark, d):
    from ..functions.vectors import mean_pool as pool

    e = table(spark, d, "embeddings").select("vec_id", pool(F.array(*[F.slice("embedding", i * 16 + 1, 16) for i in range(4)])).alias("v"))
    return e.select("vec_id", F.posexplode("v").alias("pos", "x")).select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


@query("color_normalized", "select vec_id, round((embedding[1]::double - 0.45) / 0.225, 6) red, round((embedding[33]::double - 0.5) / 0.25, 6) green from embeddings")
def color_normalized(spark, d):
    from ..functions.geometry import color_normalized as normalized

    half = lambda i: F.slice("embedding", i, 32).cast("array<double>")
    e = table(spark, d, "embeddings").select("vec_id", normalized(F.array(half(1), half(33)), [0.45, 0.5], [0.225, 0.25]).alias("c"))
    return e.select("vec_id", *[F.round(F.get(F.get("c", F.lit(i)), F.lit(0)), 6).alias(n) for i, n in enumerate(("red", "green"))])


@query("assigned_classes", f"with {ASSIGN_SQL} select clustering, count(distinct k) used from assigned group by 1")
def assigned_classes(spark, d):
    from .base import assignments

    return assignments(spark, d).groupBy("clustering").agg(F.count_distinct("centroid").alias("used"))
