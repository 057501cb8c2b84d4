"""Queries over metadata, clips, shards and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, numbers
from ..operators import clips, metadata, ordering, records
from .base import MEDIA_SQL, media, table
from .registry import query

_WORDS = "regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')"


@query("meta_filter", f"""select doc_id, source category, n_chars length from documents where n_chars between 300 and 20000
  and not list_contains({_WORDS}, 'licensed') and not (list_contains({_WORDS}, 'rights') and list_contains({_WORDS}, 'reserved')) and source not in ('src3', 'src5')""")
def meta_filter(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("length"), F.col("text").alias("title"), F.lit(None).cast("string").alias("description"), F.col("source").alias("category"))
    rules = metadata.Rules(300, 20000, title_phrases=(("licensed",), ("rights", "reserved")), categories=("src3", "src5"))
    return metadata.keep(rows, rules).select("doc_id", "category", "length")


@query("phrase_in_order", "select doc_id from documents where contains(' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ', ' mit license ') or contains(' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ', ' apache license ')")
def phrase_in_order(spark, d):
    rows = table(spark, d, "documents")
    return rows.where(metadata.has_phrase(F.col("text"), (("mit", "license"), ("apache", "license")), in_order=True)).select("doc_id")


@query("url_id", "select page_id, right(url, 11) id from pages")
def url_id(spark, d):
    return table(spark, d, "pages").select("page_id", names.url_id(F.col("url")).alias("id"))


@query("json_project", "select event_id, cast(json_extract(props, '$.k') as bigint) k from events")
def json_project(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("last_wins_dedup", "select user_id, arg_max(event_type, event_id) event_type, max(event_id) event_id from events group by user_id")
def last_wins_dedup(spark, d):
    return records.last_wins(table(spark, d, "events"), "user_id", "event_id", ["event_type", "event_id"])


@query("first_wins_lines", "select user_id, event_type, min(event_id) event_id from events group by all")
def first_wins_lines(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return records.first_wins(e, ["user_id", "event_type"], ["event_id"])


@query("skip_existing", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def skip_existing(spark, d):
    return records.not_done(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"), ["doc_id"])


@query("semi_meta", "select shard_name, count(*) shard_size from (select 'shard-' || (doc_id % 7) shard_name, doc_id from documents) where doc_id in (select doc_id from labels) group by 1")
def semi_meta(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("shard-"), (F.col("doc_id") % 7).cast("string")).alias("shard_name"))
    return records.having(rows, table(spark, d, "labels").select("doc_id"), ["doc_id"]).groupBy("shard_name").agg(F.count("*").alias("shard_size"))


def _boundaries(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("video"), (F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("2023-11-14 22:13:20")), F.col("ts").cast("timestamp_ntz")) / 1e6).alias("t"), F.col("value").alias("score"), "event_id")


_BOUND_SQL = "bounds as (select user_id video, (epoch_us(ts) - 1700000000000000) / 1e6 t, value score from events)"
_SHOTS_SQL = _BOUND_SQL + ", shots as (select video, lag(t, 1, 0.0) over (partition by video order by t) s, t e from bounds)"


@query("shot_intervals", f"with {_SHOTS_SQL} select video, round(s, 3) \"start\", round(e, 3) \"end\" from shots")
def shot_intervals(spark, d):
    s = clips.shots(_boundaries(spark, d))
    return s.select("video", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query("valid_clips", f"with {_SHOTS_SQL} select video, round((s + e) / 2 - 1800, 3) \"start\", round((s + e) / 2 + 1800, 3) \"end\" from shots where e - s >= 3600")
def valid_clips(spark, d):
    s = clips.valid(clips.shots(_boundaries(spark, d)), 3600.0, crop=True)
    return s.select("video", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query("clip_fallback", f"""with {_SHOTS_SQL}, ok as (select video, s, e from shots where e - s >= 500000), vids as (select c_custkey video, c_acctbal duration from customer)
  select video, round(s, 3) "start", round(e, 3) "end" from ok union all
  select video, round(duration / 2 - 5, 3), round(duration / 2 + 5, 3) from vids where video not in (select video from ok)""")
def clip_fallback(spark, d):
    ok = clips.valid(clips.shots(_boundaries(spark, d)), 500000.0)
    vids = table(spark, d, "customer").select(F.col("c_custkey").alias("video"), F.col("c_acctbal").alias("duration"))
    out = clips.with_fallback(ok, vids, 10.0)
    return out.select("video", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query("relaxed_count", "select c_custkey, greatest(1, ceil(6 / pow(2, (case when c_acctbal < 5000 then 1 else 0 end) + (case when c_acctbal < 1000 then 1 else 0 end))))::bigint clips from customer")
def relaxed_count(spark, d):
    return table(spark, d, "customer").select("c_custkey", clips.relaxed_count(F.col("c_acctbal"), [60.0, 5000.0, 1000.0], 6).cast("bigint").alias("clips"))


@query("anneal_threshold", f"""with recursive {_BOUND_SQL}, lv(level, threshold) as (select 0, 10.0::double union all select level + 1, threshold * 1.2::double from lv where threshold * 1.2::double < 100),
  x as (select video, level, threshold, t, lag(t, 1, 0.0) over (partition by video, level order by t) s from bounds, lv where score >= threshold),
  c as (select video, level, threshold, count(*) filter (where t - s >= 100000) n from x group by all),
  r as (select *, row_number() over (partition by video order by (case when n >= 3 then level else 1000 - level end)) rn from c)
  select video, round(threshold, 6) threshold, n from r where rn = 1""")
def anneal_threshold(spark, d):
    out = clips.annealed(_boundaries(spark, d), 3, 100000.0)
    return out.select("video", F.round("threshold", 6).alias("threshold"), "n")


@query("frame_sampling", "select doc_id, list_transform(generate_series(0, 7), lambda i: floor(i * (n_chars - 1) / 7)::int) frames from documents where n_chars > 8")
def frame_sampling(spark, d):
    return table(spark, d, "documents").where("n_chars > 8").select("doc_id", numbers.frames(F.col("n_chars"), 8).alias("frames"))


@query("clip_naming", f"with {MEDIA_SQL} select doc_id, stem clip, filename[1:11] id, try_cast(stem[13:] as int) \"start\" from media")
def clip_naming(spark, d):
    m = media(spark, d)
    f = F.col("filename")
    return m.select("doc_id", names.stem(f).alias("clip"), names.clip_id(f).alias("id"), names.clip_start(f).alias("start"))


@query("path_parts", "select page_id, regexp_extract(url, '([^/]*)$', 1) name, split_part(regexp_extract(url, '([^/]*)$', 1), '?', 1) base from pages")
def path_parts(spark, d):
    n = names.file_name(F.col("url"))
    return table(spark, d, "pages").select("page_id", n.alias("name"), F.split_part(n, F.lit("?"), F.lit(1)).alias("base"))


@query("hhmmss", """with p as (select o_orderkey, o_totalprice s, floor(o_totalprice / 3600) h from orders), q as (select *, floor((s - h * 3600) / 60) m from p)
  select o_orderkey, printf('%02d:%02d:%f', h::int, m::int, s - h * 3600 - m * 60) t from q""")
def hhmmss(spark, d):
    return table(spark, d, "orders").select("o_orderkey", numbers.hhmmss(F.col("o_totalprice")).alias("t"))


@query("eta", "select o_orderkey, (case when s >= 86400 then (s // 86400)::varchar || (case when s // 86400 = 1 then ' day, ' else ' days, ' end) else '' end) || printf('%d:%02d:%02d', s % 86400 // 3600, s % 3600 // 60, s % 60) eta from (select o_orderkey, floor(o_totalprice)::bigint s from orders)")
def eta(spark, d):
    return table(spark, d, "orders").select("o_orderkey", numbers.eta(F.col("o_totalprice")).alias("eta"))


@query("shard_sizes", f"with {MEDIA_SQL} select doc_id, shard_name, count(*) over (partition by shard_name) shard_size from media")
def shard_sizes(spark, d):
    return records.with_shard_size(media(spark, d)).select("doc_id", "shard_name", "shard_size")


@query("shard_complete", f"""with {MEDIA_SQL}, have as (select shard_name, count(*) have from media where doc_id % 97 <> 5 group by 1), size as (select shard_name, count(*) shard_size from media group by 1)
  select shard_name, have, shard_size from have join size using (shard_name) where have >= round_even(shard_size * 0.99, 0)""")
def shard_complete(spark, d):
    m = media(spark, d)
    return records.complete_shards(m.where("doc_id % 97 <> 5"), m.groupBy("shard_name").agg(F.count("*").alias("shard_size")), 0.99)


@query("shard_partition", """with logs as (select o_orderkey % 50 part, o_orderdate::varchar ts, o_custkey % 40 s from orders),
  latest as (select s, arg_max(part, (ts, part)) p from logs group by s) select n_nationkey shard_name, coalesce(p, -1) "partition" from nation left join latest on s = n_nationkey""")
def shard_partition(spark, d):
    logs = table(spark, d, "orders").select((F.col("o_orderkey") % 50).alias("partition"), F.col("o_orderdate").cast("string").alias("timestamp"), F.array(F.col("o_custkey") % 40).alias("shards"))
    return records.shard_partitions(table(spark, d, "nation").select(F.col("n_nationkey").alias("shard_name")), logs)


@query("meta_left_join", "select d.doc_id, coalesce(quality, -1) quality, coalesce(toxic, -1) toxic from documents d left join labels l using (doc_id)")
def meta_left_join(spark, d):
    return records.with_metadata(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"], {"quality": F.lit(-1), "toxic": F.lit(-1)})


@query("output_rows", f"""with {MEDIA_SQL}, meta as (select shard_name, stem, right(url, 11) id, '[' || doc_id || '.0, ' || (doc_id + 10) || '.0]' segment from media join pages on page_id = doc_id)
  select m.shard_name, m.stem, coalesce(id, '-1') id, coalesce(segment, '[-1.0, -1.0]') segment from media m left join meta using (shard_name, stem)""")
def output_rows(spark, d):
    m = media(spark, d)
    n = F.col("doc_id").cast("double")
    meta = m.join(table(spark, d, "pages"), F.col("page_id") == F.col("doc_id")).select("shard_name", "stem", names.url_id(F.col("url")).alias("id"), F.array(n, n + 10).alias("segment"))
    out = records.output_rows(m.select("shard_name", "stem"), meta)
    return out.withColumn("segment", names.segment_text(F.col("segment")))


@query("dup_files", "select source, count(*) n from documents group by source having count(*) > 1")
def dup_files(spark, d):
    return records.duplicates(table(spark, d, "documents"), ["source"])


@query("completeness", "select l_orderkey, count(*) n from lineitem group by 1 having count(*) <> 4")
def completeness(spark, d):
    return records.completeness(table(spark, d, "lineitem"), ["l_orderkey"], 4)


@query("flatten_features", "select vec_id, 'm' || (1 + (g % 2)) model_key, 'layer_' || g layer, round(embedding[g * 8 + 1]::double, 6) head from (select *, unnest(generate_series(0, 7)) g from embeddings)")
def flatten_features(spark, d):
    e = table(spark, d, "embeddings")
    maps = [F.map_from_arrays(F.array(*[F.lit(f"layer_{g}") for g in range(k, 8, 2)]), F.array(*[F.slice("embedding", g * 8 + 1, 8) for g in range(k, 8, 2)])) for k in (0, 1)]
    rows = e.select("vec_id", F.array(*[F.struct(F.lit(f"m{k + 1}").alias("model_key"), m.alias("array")) for k, m in enumerate(maps)]).alias("features"))
    return records.flatten_features(rows).select("vec_id", "model_key", "layer", F.round(F.get("value", F.lit(0)).cast("double"), 6).alias("head"))


@query("group_samples", f"with {MEDIA_SQL} select shard_name, stem prefix, 1 + doc_id % 3 parts, case when doc_id % 3 > 0 then n_chars::varchar end json from media")
def group_samples(spark, d):
    m = media(spark, d).select("shard_name", "stem", F.col("n_chars").cast("string").alias("content"), F.explode(F.slice(F.array(*map(F.lit, ("mp4", "JSON", "txt"))), 1, (F.col("doc_id") % 3 + 1).cast("int"))).alias("e"))
    members = m.select("shard_name", F.concat("stem", F.lit("."), "e").alias("name"), "content")
    return records.samples_by_prefix(members).select("shard_name", "prefix", F.size("sample").cast("bigint").alias("parts"), F.try_element_at("sample", F.lit("json")).alias("json"))


@query("unselected", "select doc_id from (select doc_id from documents union all select doc_id from labels) group by 1 having count(*) = 1")
def unselected(spark, d):
    return records.once(table(spark, d, "documents").select("doc_id").unionAll(table(spark, d, "labels").select("doc_id")), ["doc_id"])


@query("covering_models", "select s_nationkey epoch, list_sort(list(distinct s_suppkey % 5)) shards from supplier group by 1 having bool_and(s_suppkey % 5 < 3)")
def covering_models(spark, d):
    m = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("epoch")).agg(F.sort_array(F.collect_set(F.col("s_suppkey") % 5)).alias("shards"))
    return records.covering_models(m, [0, 1, 2])


@query("det_shuffle", "select vec_id id, row_number() over (order by md5('7-' || vec_id), vec_id) - 1 pos from embeddings")
def det_shuffle(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id")).withColumn("draw", ordering.draw(7))
    return ordering.numbered(e, ["draw", "id"]).select("id", "pos")


@query("sample_n", "select doc_id id from documents order by md5('98052-' || doc_id), doc_id limit 50")
def sample_n(spark, d):
    return ordering.sample(table(spark, d, "documents").select(F.col("doc_id").alias("id")), 50, 98052)


@query("sample_per_video", "select id, source from (select doc_id id, source, row_number() over (partition by source order by md5('3-' || doc_id), doc_id) rn from documents) where rn <= 3")
def sample_per_video(spark, d):
    return ordering.sample_by(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), ["source"], 3, 3)


@query("per_file_topk", "select source, doc_id, n_chars from (select *, row_number() over (partition by source order by n_chars desc, doc_id) rn from documents) where rn <= 5")
def per_file_topk(spark, d):
    return ordering.top_by(table(spark, d, "documents"), ["source"], "n_chars", 5, "doc_id").select("source", "doc_id", "n_chars")


@query("merge_scored", "select l_returnflag, l_partkey, max(l_quantity) score from lineitem group by all")
def merge_scored(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_partkey", F.col("l_quantity").alias("score"))
    return ordering.merged_scores([li.where("l_returnflag = 'A'"), li.where("l_returnflag <> 'A'")], ["l_returnflag", "l_partkey"])


@query("ranked_merge", "select l_returnflag, l_partkey from lineitem group by all")
def ranked_merge(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_partkey", F.col("l_quantity").alias("score"))
    return ordering.ranked_merge([li.where("l_returnflag = 'A'"), li.where("l_returnflag <> 'A'")], "score", ["l_returnflag", "l_partkey"])


@query("chunking", "select vec_id, (row_number() over (order by vec_id) - 1) // 64 by_size, (row_number() over (order by vec_id) - 1) // ceil(count(*) over () / 7)::bigint by_parts from embeddings")
def chunking(spark, d):
    e = table(spark, d, "embeddings").select("vec_id")
    n = ordering.numbered(e, ["vec_id"]).crossJoin(F.broadcast(e.agg(F.count("*").alias("rows"))))
    return n.select("vec_id", ordering.chunks_of(F.col("pos"), 64).alias("by_size"), ordering.chunks_into(F.col("pos"), F.col("rows"), 7).alias("by_parts"))


@query("striding", "select vec_id, (row_number() over (order by vec_id) - 1) % 4 worker from embeddings")
def striding(spark, d):
    n = ordering.numbered(table(spark, d, "embeddings").select("vec_id"), ["vec_id"])
    return n.select("vec_id", ordering.strides(F.col("pos"), 4).alias("worker"))


@query("shard_split", "select vec_id, least((row_number() over (order by vec_id) - 1) // (count(*) over () // 6), 5) shard from embeddings")
def shard_split(spark, d):
    e = table(spark, d, "embeddings").select("vec_id")
    n = ordering.numbered(e, ["vec_id"]).crossJoin(F.broadcast(e.agg(F.count("*").alias("rows"))))
    return n.select("vec_id", ordering.shard_even(F.col("pos"), F.col("rows"), 6).alias("shard"))


@query("split_train_test", "select vec_id, row_number() over (partition by label order by vec_id) <= round_even(count(*) over (partition by label) * 0.75, 0) is_train from embeddings")
def split_train_test(spark, d):
    return ordering.split_by_class(table(spark, d, "embeddings").select("vec_id", "label"), "label", 0.75, ["vec_id"]).select("vec_id", "is_train")


@query("class_index", "select doc_id, dense_rank() over (order by source) - 1 label, clip from documents, (select unnest(generate_series(0, 2)) clip)")
def class_index(spark, d):
    found = ordering.class_numbers(table(spark, d, "documents").select("doc_id", "source"), "source")
    return found.select("doc_id", "label", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("clip"))


@query("fold_split", "select doc_id, (doc_id % 5) + 1 fold, regexp_extract(stem, '-([^-]*)$', 1) label, split_part(stem, '-', 1)::int <> 2 is_train from (select doc_id, ((doc_id % 5) + 1) || '-' || doc_id || '-' || source stem from documents)")
def fold_split(spark, d):
    s = F.concat_ws("-", (F.col("doc_id") % 5 + 1).cast("string"), F.col("doc_id").cast("string"), "source")
    return ordering.folds(table(spark, d, "documents").select("doc_id", s.alias("stem")), "stem", 2).select("doc_id", F.col("fold").cast("bigint").alias("fold"), "label", "is_train")


@query("drop_remainder", "select shard from (select distinct source shard from documents) order by shard limit (select count(distinct source) // 7 * 7 from documents)")
def drop_remainder(spark, d):
    return ordering.without_remainder(table(spark, d, "documents").select(F.col("source").alias("shard")).distinct(), "shard", 7)


@query("epoch_length", "with s as (select n_nationkey pos, n_nationkey * 37 % 11 + 5 n from nation) select max(b) batches from (select ceil(sum(n) / 4)::bigint b from s group by pos % 3, (pos // 3) % 2)")
def epoch_length(spark, d):
    sizes = table(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), (F.col("n_nationkey") * 37 % 11 + 5).alias("n"))
    return ordering.epoch_length(sizes, 3, 2, 4)


@query("size_cache", "select source shard_name, case when source in ('src1', 'src2') then 7 else count(*) end shard_size from documents group by 1")
def size_cache(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("shard_name"))
    return records.new_sizes(rows, rows.where("shard_name in ('src1', 'src2')").distinct().withColumn("shard_size", F.lit(7).cast("bigint")))


@query("merge_parts", "select doc_id, coalesce(l.quality + 10, d.doc_id % 3)::bigint v from documents d left join labels l using (doc_id)")
def merge_parts(spark, d):
    a = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 3).alias("v"))
    b = table(spark, d, "labels").select("doc_id", (F.col("quality") + 10).cast("bigint").alias("v"))
    return records.merged_last_wins([a, b], "doc_id", ["v"])


@query("nan_guard", "select o_orderkey, o_totalprice from orders")
def nan_guard(spark, d):
    return records.no_nan(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


@query("brace_form", "select n_regionkey, '{' || string_agg(n_name, ',' order by n_name) || '}' pattern from nation group by 1")
def brace_form(spark, d):
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    return n.select("n_regionkey", names.brace_form(F.col("names")).alias("pattern"))


@query("run_ids", "select s_suppkey, s_name || '_' || s_suppkey || '_' || s_nationkey run, split_part('v' || s_nationkey || '_l_' || s_suppkey, '_', 1) \"view\", 'l_' || s_suppkey layer from supplier")
def run_ids(spark, d):
    s = table(spark, d, "supplier")
    key = F.concat(F.lit("v"), F.col("s_nationkey").cast("string"), F.lit("_l_"), F.col("s_suppkey").cast("string"))
    return s.select("s_suppkey", names.run_id(F.col("s_name"), F.col("s_suppkey"), F.col("s_nationkey")).alias("run"), names.view_of(key).alias("view"), names.layer_of(key).alias("layer"))
