"""Registered queries of the core library, by the operators they show, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import arrays, text
from loomline.operators import clean, dedup, dml, evaluate, inference, predicates
from loomline.plans import fixtures, runner
from loomline.plans.fixtures import LEVELS, SQL
from loomline.plans.registry import Registry, Transformer
from loomline.session import spread, table, work_path
from loomline.sources import readers, writers
from loomline.sources.marks import Marks
from loomline.streaming import increments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, grid: bool = False):
    """Register a query under its function's name; ``grid``: the SQL reads the derived items and answers."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"with {SQL}, {sql}" if grid and sql.lstrip().startswith("w ") else f"with {SQL} {sql}" if grid else sql
        return f

    return add


_BY_LEVEL = "coalesce(lvl, 'All') difficulty_level, cast({hit} as bigint) cnt_correct, cast({all} as bigint) cnt_total, case when {all} > 0 then {hit} / {all}::double else 0.0 end accuracy"


# -- evaluation


@query(f"select model, run, {_BY_LEVEL.format(hit='count(*) filter (answer = gold)', all='count(answer)')} from grid group by grouping sets ((model, run, lvl), (model, run))", grid=True)
def agg1_accuracy_by_level(spark, d):
    return evaluate.accuracy(fixtures.answers(spark, d), ["model", "run"], LEVELS).withColumn("run", F.col("run").cast("long"))


@query(f"w as (select model, id, lvl, bool_or(coalesce(answer = gold, false)) hit from grid group by all) select model, {_BY_LEVEL.format(hit='count(*) filter (hit)', all='count(*)')} from w group by grouping sets ((model, lvl), (model))", grid=True)
def agg2_pass_at_k(spark, d):
    return evaluate.pass_at_k(fixtures.answers(spark, d), LEVELS)


_THREE = "w as (select model, id, count(*) n, count(*) filter (answer = gold) r from grid where answer is not null and model <> 'm2' group by all having count(*) = 3)"


def _three_runs(spark, d):
    return fixtures.answers(spark, d).filter("answer is not null and model <> 'm2'")


@query(f"{_THREE}, f as (select model, count(*) n from grid where answer is not null and run in (1, 4) group by model) select f.model, count(*) filter (r > 0) cnt_correct, any_value(f.n) cnt_total, count(*) filter (r > 0) / any_value(f.n)::double accuracy from f join w using (model) group by f.model", grid=True)
def agg3_pass_at_k_of_files(spark, d):
    return evaluate.pass_at_k_of_files(_three_runs(spark, d), 3)


@query(f"{_THREE} select model, count(*) filter (r > 1.5) cnt_correct, count(*) cnt_total, count(*) filter (r > 1.5) / count(*)::double accuracy from w group by model", grid=True)
def agg4_ensemble(spark, d):
    return evaluate.ensemble(_three_runs(spark, d), 3)


@query("w as (select model, id, answer, count(answer) n, min(run) f from grid group by all), k as (select *, row_number() over (partition by model, id order by n desc, f) rn from w) select model, id, case when n > 0 then answer end answer from k where rn = 1", grid=True)
def agg5_vote(spark, d):
    return evaluate.vote(fixtures.answers(spark, d))


@query("w as (select model, id, answer, count(*) n from grid group by all), v as (select *, sum(n) over (partition by model, id) t from w) select model, id, max(case when n > t // 2 then answer end) answer from v group by model, id", grid=True)
def agg6_majority(spark, d):
    return evaluate.majority(fixtures.answers(spark, d))


@query("select answer, count(*) cnt from grid where answer is not null group by 1", grid=True)
def agg7_value_counts(spark, d):
    return evaluate.counts(fixtures.answers(spark, d), "answer")


@query("select lvl as level, count(id) cnt from items group by 1", grid=True)
def agg8_count_by_level(spark, d):
    return fixtures.items(spark, d).groupBy("level").agg(F.count("id").alias("cnt"))


@query("w as (select unnest(topics) topic, id from items), k as (select topic from (select distinct * from w) group by topic order by count(*) desc, topic limit 10), g as (select model, unnest(topics) topic, answer, gold from grid) select model, topic, avg(case when answer = gold then 1 else 0 end) accuracy, count(*) cnt from g where topic in (select topic from k) group by 1, 2", grid=True)
def agg9_accuracy_by_topic(spark, d):
    return evaluate.by_topic(fixtures.answers(spark, d))


@query("w as (select id, lvl, topics, bool_or(coalesce(answer = gold, false)) hit from grid group by all) select 'topic' kind, topic as name, count(*) filter (hit) cnt_correct, count(*) cnt_total from (select unnest(topics) topic, hit from w) group by 2 union all select 'level', lvl, count(*) filter (hit), count(*) from w group by 2", grid=True)
def agg10_counters(spark, d):
    return evaluate.counters(fixtures.answers(spark, d))


@query("select model, " + ", ".join(f"count(*) filter (answer = gold and ({c})) / count(answer) filter ({c})::double \"{n}\"" for n, c in [*((x, f"lvl = '{x}'") for x in LEVELS), ("All", "true")]) + " from grid group by model", grid=True)
def agg11_pivot(spark, d):
    return evaluate.pivot_levels(evaluate.accuracy(fixtures.answers(spark, d), ["model"], LEVELS), ["model"], LEVELS)


@query("select event_type model, round(avg(k), 6) mean_in, round(avg(2 * k), 6) mean_out, round(avg(k) / 1000 * 0.55 + avg(2 * k) / 1000 * 2.2, 6) cost_per_1k_answers from (select event_type, cast(json_extract_string(props, '$.k') as bigint) k from events) group by 1")
def agg12_token_cost(spark, d):
    found = evaluate.token_cost(evaluate.usage_of(fixtures.responses(spark, d)), *evaluate.PRICES["o3-mini"])
    return found.select("model", *[F.round(c, 6).alias(c) for c in found.columns if c != "model"])


@query("select round((avg(len(string_split(question, ' '))) + avg(len(string_split(array_to_string(options, ' '), ' '))) + 40) * 4 / 3, 6) tokens_in from items", grid=True)
def agg13_words_as_tokens(spark, d):
    return evaluate.words_as_tokens(fixtures.items(spark, d), 40).select(F.round("tokens_in", 6).alias("tokens_in"))


_NORMAL = r"trim(regexp_replace(regexp_replace(lower(replace(replace(strip_accents({x}), 'đ', 'd'), 'Đ', 'D')), '[^a-zA-Z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"
_TERMS = f"d as (select doc_id, {_NORMAL.format(x='text')} q from documents), t as (select doc_id, term, count(*) tf from (select doc_id, unnest(string_split(q, ' ')) term from d) where length(term) >= 2 group by all), f as (select term, count(*) df from t group by term having count(*) >= 5 and count(*) <= 0.8 * (select count(*) from d))"


@query(f"with {_TERMS} select term, df from f")
def agg14_document_frequency(spark, d):
    return dedup.frequencies(dedup.normalise(fixtures.documents(spark, d)))[0]


@query("select event_type, user_id % 7 as part, max({'ts': ts, 'event_id': event_id}).event_id event_id from events group by 1, 2")
def agg17_last_of_hash(spark, d):
    events = table(spark, d, "events").select("event_id", "ts", "event_type", (F.col("user_id") % 7).alias("part"))
    hashed = events.withColumn("hash", text.row_hash(dict(events.dtypes), ["event_type", "part"]))
    return dml.last_of_hash(hashed, "hash", ["ts", "event_id"]).select("event_type", "part", "event_id")


@query(f"{_THREE}, e as (select model, count(*) filter (r > 1.5) / count(*)::double ensemble from w group by model), s as (select model, count(*) filter (answer = gold) / count(answer)::double single from grid where run in (1, 4) group by model) select model, ensemble, single, ensemble - single improvement from e join s using (model)", grid=True)
def agg18_improvement(spark, d):
    single = evaluate.accuracy(fixtures.answers(spark, d).filter("run in (1, 4)"), ["model"]).filter("difficulty_level = 'All'")
    return evaluate.improvement(single, evaluate.ensemble(_three_runs(spark, d), 3))


@query("select distinct model, model || '__sf0__run' || (run - 1) as file, 0 as shuffle, dense_rank() over (partition by model order by run) run from grid", grid=True)
def agg19_run_numbers(spark, d):
    named = fixtures.answers(spark, d).select(F.concat("model", F.lit("__sf0__run"), (F.col("run") - 1).cast("string")).alias("file")).distinct()
    parts = readers.run_of_file(F.col("file"))
    files = named.select("file", parts["model"].alias("model"), parts["shuffle"].alias("shuffle"))
    return evaluate.run_numbers(files).withColumn("run", F.col("run").cast("long"))


@query("w as (select unnest(['A', 'B', 'C', 'D']) label), s as (select label, count(*) filter (gold = label and coalesce(answer = label, false)) tp, count(*) filter (gold <> label and coalesce(answer = label, false)) fp, count(*) filter (gold = label and not coalesce(answer = label, false)) fn from grid, w group by label) select *, 2.0::double * tp / (2 * tp + fp + fn) f1 from s", grid=True)
def agg21_f1(spark, d):
    return evaluate.f1_scores(fixtures.answers(spark, d))


@query("select * from (select distinct case user_id % 3 when 0 then 'o3-mini' when 1 then 'qwen3' else 'none' end as model from events) left join (values " + ", ".join(f"('{m}', {i}::double, {o}::double)" for m, (i, o) in evaluate.PRICES.items()) + ") p(model, price_in, price_out) using (model)")
def cst4_accuracy_and_cost(spark, d):
    models = table(spark, d, "events").select(F.when(F.col("user_id") % 3 == 0, "o3-mini").when(F.col("user_id") % 3 == 1, "qwen3").otherwise("none").alias("model")).distinct()
    return evaluate.accuracy_and_cost(models, evaluate.price_list(spark))


@query("with t as (select conv_id % 5 as part, avg(len(string_split(text, ' '))) filter (role = 'user') as i, avg(len(string_split(text, ' '))) filter (role <> 'user') as o from conversations group by 1) select part, round(i / 1e3 * 1.35 + o / 1e3 * 5.4, 6) cost_per_1k_answers from t")
def cst3_literal_cost(spark, d):
    """The cost of a thousand answers at the mean lengths, in words, of what is asked and said in a fifth of the conversations each."""
    words = lambda who: F.avg(F.when(who, text.word_count("text")))
    user = F.col("role") == "user"
    means = table(spark, d, "conversations").groupBy((F.col("conv_id") % 5).alias("part")).agg(words(user).alias("i"), words(~user).alias("o"))
    return means.select("part", F.round(evaluate.cost_per_1k(F.col("i"), F.col("o"), *map(F.lit, evaluate.PRICES["deepseek-r1"])), 6).alias("cost_per_1k_answers"))


# -- joins


@query("select i.id, i.gold, a.run, a.answer from items i left join (select id, run, answer from grid where answer is not null and run = 2) a using (id)", grid=True)
def jn1_attach_answers(spark, d):
    run = fixtures.answers(spark, d).filter("run = 2 and answer is not null").select("id", F.col("run").cast("long").alias("run"), "answer")
    return fixtures.items(spark, d).select("id", "gold").join(run, "id", "left")


@query("with a as (select c_custkey, row_number() over (order by c_custkey) - 1 pos from customer), b as (select o_orderkey, row_number() over (order by o_orderkey) - 1 pos from orders) select pos, c_custkey, o_orderkey from a join b using (pos)")
def jn3_positional_join(spark, d):
    left = predicates.numbered(table(spark, d, "customer").select("c_custkey"), [F.col("c_custkey")], "pos")
    right = predicates.numbered(table(spark, d, "orders").select("o_orderkey"), [F.col("o_orderkey")], "pos")
    return left.join(right, "pos").select("pos", "c_custkey", "o_orderkey")


@query("with a as (select c_custkey, c_mktsegment, row_number() over (order by c_custkey) - 1 pos from customer), b as (select n_name, row_number() over (order by n_nationkey) - 1 pos from nation) select c_custkey, c_mktsegment, n_name from a left join b using (pos)")
def jn2_base_with_run(spark, d):
    base = predicates.numbered(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), [F.col("c_custkey")], "pos")
    run = predicates.numbered(table(spark, d, "nation").select("n_name", "n_nationkey"), [F.col("n_nationkey")], "pos")
    return base.join(run, "pos", "left").select("c_custkey", "c_mktsegment", "n_name")


@query("select id, max_by(answer, run) answer from grid where answer is not null group by id", grid=True)
def jn4_last_wins_lookup(spark, d):
    known = fixtures.answers(spark, d).filter("answer is not null").groupBy("id").agg(F.max_by("answer", "run").alias("answer"))
    return fixtures.items(spark, d).select("id").join(known, "id")


@query("select id from grid where answer is not null group by id having count(distinct run) = 7", grid=True)
def jn5_ids_of_all_runs(spark, d):
    return fixtures.answers(spark, d).filter("answer is not null").groupBy("id").agg(F.count_distinct("run").alias("n")).filter("n = 7").select("id")


@query("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def jn6_semi_join(spark, d):
    chosen = table(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    return table(spark, d, "orders").join(chosen, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def jn7_anti_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


_PAIRS = _TERMS + ", w as (select doc_id, t.term, tf * (ln((1.0 + (select count(*) from d)) / (1 + df)) + 1) w from t join f using (term)), m as (select doc_id, sqrt(sum(w * w)) m from w group by 1), v as (select doc_id, term, w / m w from w join m using (doc_id)), p as (select a.doc_id i, b.doc_id j, 1 - sum(a.w * b.w) distance from v a join v b on a.term = b.term and a.doc_id < b.doc_id group by 1, 2 having 1 - sum(a.w * b.w) < 0.1)"


@query(f"with {_PAIRS} select i, j, round(distance, 6) + 0.0 distance from p")
def jn10_cosine_pairs(spark, d):
    pairs = dedup.cosine_pairs(dedup.normalise(fixtures.documents(spark, d)))
    return pairs.select("i", "j", (F.round("distance", 6) + 0.0).alias("distance"))


@query("select r_name as name, r_regionkey as config, '[' || string_agg('{\"part_name\":\"' || n_name || '\",\"config\":' || n_nationkey || '}', ',' order by n_name) || ']' as parts from region join nation on n_regionkey = r_regionkey group by all")
def jn11_config_assembly(spark, d):
    regions, nations = table(spark, d, "region"), table(spark, d, "nation")
    links = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("name"), F.col("n_name").alias("part_name"))
    return dml.with_dependencies(regions.select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("config")), links, nations.select(F.col("n_name").alias("part_name"), F.col("n_nationkey").alias("config")))


def _staged(spark, d):
    """Changes to the customers of one segment, some of them twice, and rows of new keys."""
    chosen = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'")
    once = chosen.select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.when(F.col("c_acctbal") < 0, None).otherwise("CHANGED").alias("c_mktsegment"), F.lit(1).alias("version"))
    twice = chosen.filter("c_nationkey < 10").select("c_custkey", (F.col("c_acctbal") + 2).alias("c_acctbal"), F.lit("TWICE").alias("c_mktsegment"), F.lit(2).alias("version"))
    both = once.unionByName(twice)
    return both.unionByName(both.withColumn("c_custkey", -F.col("c_custkey") - 1))


_STAGED = "b as (select c_custkey, c_acctbal + 1 c_acctbal, case when c_acctbal >= 0 then 'CHANGED' end c_mktsegment, 1 v from customer where c_mktsegment = 'BUILDING' union all select c_custkey, c_acctbal + 2, 'TWICE', 2 from customer where c_mktsegment = 'BUILDING' and c_nationkey < 10), s as (select c_custkey, c_acctbal, c_mktsegment from (select *, row_number() over (partition by c_custkey order by v desc) k from b) where k = 1), n as (select -c_custkey - 1 c_custkey, c_acctbal, c_mktsegment from s)"
_UPDATED = "select t.c_custkey, t.c_name, t.c_nationkey, coalesce(s.c_acctbal, t.c_acctbal) c_acctbal, case when s.c_custkey is null then t.c_mktsegment else s.c_mktsegment end c_mktsegment from customer t left join s on s.c_custkey = t.c_custkey"


@query(f"with {_STAGED} {_UPDATED}")
def jn12_update_join(spark, d):
    return dml.update(table(spark, d, "customer"), _staged(spark, d), ["c_custkey"], order=["version"])


@query(f"with {_STAGED} {_UPDATED} union all select c_custkey, null, null, c_acctbal, c_mktsegment from n")
def jn13_upsert(spark, d):
    return dml.upsert(table(spark, d, "customer"), _staged(spark, d), ["c_custkey"], order=["version"])


@query(f"with {_STAGED} select * from customer union all select c_custkey, null, null, c_acctbal, c_mktsegment from n")
def dml3_insert_or_ignore(spark, d):
    return dml.insert_or_ignore(table(spark, d, "customer"), _staged(spark, d), ["c_custkey"], ["version"])


# -- predicates, order, pages


@query("select o_orderkey from orders where o_orderstatus in ('F', 'O') and (o_totalprice > 100000 or o_orderpriority like '1-%' or o_orderpriority not like '%-%') and o_custkey is not null and o_custkey < o_orderkey + 100 and o_orderstatus not in ('P', 'X') and o_totalprice >= 1000 and o_totalprice <= 300000 and o_orderpriority <> '5-LOW' and o_orderstatus is distinct from 'Z' and o_orderkey = o_orderkey")
def prd1_predicate_tree(spark, d):
    tree = {"logical": "and", "conditions": [
        {"field": "o_orderstatus", "operator": "=", "value": ["F", "O"]},
        {"logical": "or", "conditions": [
            {"field": "o_totalprice", "operator": ">", "value": 100000},
            {"field": "o_orderpriority", "operator": "LIKE", "value": "1-%"},
            {"field": "o_orderpriority", "operator": "NOT LIKE", "value": "%-%"},
        ]},
        {"field": "o_custkey", "operator": "!=", "value": None},
        {"field": "o_custkey", "operator": "<", "value": predicates.Sql("o_orderkey + 100")},
        {"field": "o_orderstatus", "operator": "NOT IN", "value": ["P", "X"]},
        {"field": "o_totalprice", "operator": ">=", "value": 1000},
        {"field": "o_totalprice", "operator": "<=", "value": 300000},
        {"field": "o_orderpriority", "operator": "!=", "value": "5-LOW"},
        {"field": "o_orderstatus", "operator": "IS NOT", "value": "Z"},
        {"field": "o_orderkey", "operator": "IN", "value": predicates.Sql("(o_orderkey)")},
    ]}
    return table(spark, d, "orders").filter(predicates.where(tree)).select("o_orderkey")


@query("select event_id, ts, value from events where ts > (select max(ts) from events where cast(ts as date) < date '2024-01-16') and event_type <> 'click'")
def prd8_incremental(spark, d):
    events = table(spark, d, "events")
    mark = readers.high_water_mark(events.filter("to_date(ts) < date'2024-01-16'"), "ts")
    return readers.scan_table(events, ["event_id", "value"], "ts", mark, filters={"field": "event_type", "operator": "!=", "value": "click"})


@query("with e as (select event_id, cast(ts as date) as day, ts < timestamp '2024-01-16' and event_id % 10 <> 0 early from events), m as (select max(day) mark from e where early) select event_id, day, cast(case when early then 0 else 1 end as bigint) as version from e, m where early or day >= mark")
def stm1_marks(spark, d):
    """Two loads: of what was there before a day, and of all that is there later, late rows of the last day among it."""
    events = table(spark, d, "events").select("event_id", F.to_date("ts").alias("day"), "ts")
    store = Marks(spark, work_path(spark, "loads"))
    store.load("events", events.filter("ts < timestamp'2024-01-16' and event_id % 10 <> 0").drop("ts"), "day", ">=")
    store.load("events", events.drop("ts"), "day", ">=")
    return store.read("events")


@query("select doc_id, source from (select doc_id, case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then 'Other(No Category)' else source end source from documents) where source is distinct from 'Other(No Category)'")
def prd9_off_topic(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id", "case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then 'Other(No Category)' else source end as source")
    return docs.filter(~F.col("source").eqNullSafe(dedup.OFF_TOPIC))


@query("select page_id, regexp_full_match(cast(page_id as varchar), '[0-9]+') digits, length(trim(url)) > 0 and length(url) <= 64 named, url like 'http%' allowed, length(url) >= 8 and regexp_matches(url, '[A-Za-z]') and regexp_matches(url, '[0-9]') as password, page_id % 2 = 0 as email, page_id % 3 < 2 as chosen, page_id % 2 = 0 as timed, page_id % 4 < 2 or regexp_full_match(h, '.{12}4.{3}[89ab].{15}') as uuid from (select *, md5(cast(page_id as varchar)) h from pages)")
def prd13_validators(spark, d):
    pages, key = table(spark, d, "pages"), F.col("page_id").cast("string")
    plain = F.md5(key.cast("binary"))
    made = F.concat(F.substring(plain, 1, 12), F.lit("4"), F.substring(plain, 14, 3), F.lit("A"), F.substring(plain, 18, 15))
    parts = F.concat_ws("-", *[F.substring(made, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    uuid = F.when(F.col("page_id") % 4 == 0, made).when(F.col("page_id") % 4 == 1, parts).otherwise(plain)
    return pages.select(
        "page_id", predicates.is_digits(key).alias("digits"), predicates.is_name(F.col("url")).alias("named"), F.startswith("url", F.lit("http")).alias("allowed"), predicates.is_password(F.col("url")).alias("password"),
        predicates.is_email(F.concat(key, F.when(F.col("page_id") % 2 == 0, "@example.org").otherwise("@example..org"))).alias("email"), predicates.is_one_of(F.col("page_id") % 3, [0, 1]).alias("chosen"),
        predicates.is_time(F.concat(F.lit("2024-02-"), F.when(F.col("page_id") % 2 == 0, "28").otherwise("31"), F.lit("T00:00:00Z"))).alias("timed"), predicates.is_uuid4(uuid).alias("uuid"),
    )


@query("select i.item_id, d.doc_id from benchmark i join documents d on contains(d.text, i.text)")
def prd14_containment(spark, d):
    return dedup.containments(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", "text")).select("item_id", "doc_id")


@query("select o_orderkey, o_custkey, o_totalprice from orders order by o_orderdate desc, o_orderkey limit 50 offset 20")
def srt1_order_and_page(spark, d):
    frame = table(spark, d, "orders").orderBy(*predicates.order_by([{"field": "o_orderdate", "direction": "DESC"}, "o_orderkey"]))
    return predicates.limit_offset(frame, 50, 20).select("o_orderkey", "o_custkey", "o_totalprice")


@query("select c_custkey, (row_number() over (order by c_acctbal, c_custkey) - 1) // 25 page from customer")
def lim2_pages(spark, d):
    return predicates.pages(table(spark, d, "customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal"), F.col("c_custkey")], 25).select("c_custkey", "page")


@query("select p_type, count(*) cnt from part group by 1 order by 2 desc, 1 limit 10")
def lim3_top_k(spark, d):
    return evaluate.top_values(table(spark, d, "part"), "p_type")


@query("select doc_id, row_number() over (order by doc_id) - 1 dedup_id from documents where source is distinct from 'src1'")
def srt4_sequential_id(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.when(F.col("source") == "src1", dedup.OFF_TOPIC).otherwise(F.col("source")).alias("topic"))
    return dedup.drop_off_topic(docs).select(F.col("idx").alias("doc_id"), "dedup_id")


# -- sets


@query("select n_name as name, n_regionkey as region from nation union all select r_name, null from region")
def set1_union(spark, d):
    return runner.concat([table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), table(spark, d, "region").select(F.col("r_name").alias("name"))])


@query("select o_custkey as custkey from orders intersect select c_custkey from customer where c_acctbal > 0 intersect select o_custkey from orders where o_orderstatus = 'F'")
def set3_intersect(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderstatus")
    rich = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("custkey"))
    return runner.intersection([orders.select("custkey"), rich, orders.filter("o_orderstatus = 'F'").select("custkey")])


@query("select lvl as level, count(*) cnt, case lvl when 'Hard' then 0 else 1 end place from items where lvl in ('Hard', 'Easy') group by lvl", grid=True)
def srt5_list_order(spark, d):
    counted = fixtures.items(spark, d).groupBy("level").agg(F.count("*").alias("cnt"))
    return evaluate.in_list_order(counted, "level", ["Hard", "Easy"])


@query("select distinct model || '__sf0__run' || (run - 1) as file, model from grid", grid=True)
def str14_model_of_run(spark, d):
    named = fixtures.answers(spark, d).select(F.concat("model", F.lit("__sf0__run"), (F.col("run") - 1).cast("string")).alias("file")).distinct()
    return named.select("file", evaluate.model_of_run(F.col("file")).alias("model"))


@query("select distinct l_returnflag, l_linestatus from lineitem")
def set4_distinct(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("select c_custkey from customer except all select o_custkey from orders where o_totalprice > 300000")
def set6_except(spark, d):
    return table(spark, d, "customer").select("c_custkey").exceptAll(table(spark, d, "orders").filter("o_totalprice > 300000").select("o_custkey"))


# -- text


@query(f"select doc_id, {_NORMAL.format(x='text')} normal from documents")
def str2_normal_form(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", text.normal_form("text").alias("normal"))


@query("select doc_id, replace(replace(strip_accents(text), 'đ', 'd'), 'Đ', 'D') bare from documents")
def str1_remove_accents(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", text.remove_accents("text").alias("bare"))


@query("select p_partkey, trim(regexp_replace('cau ' || p_size || ' ' || p_name || ' cau 7', 'cau [0-9]+', '', 'g')) bare, p_name question from part")
def str4_questions(spark, d):
    part = table(spark, d, "part")
    named = part.select("p_partkey", F.concat(F.lit("cau "), F.col("p_size").cast("string"), F.lit(" "), "p_name", F.lit(" cau 7")).alias("a"), F.concat(F.lit("Câu "), F.lit("số "), F.col("p_size").cast("string"), F.lit(". "), "p_name").alias("b"))
    return named.select("p_partkey", text.strip_numbers_of_questions("a").alias("bare"), text.better_question("b").alias("question"))


@query("select id, options from items", grid=True)
def str5_options(spark, d):
    marked = fixtures.items(spark, d).withColumn("options", F.transform("options", lambda o, i: F.concat(text.index_letter(i), F.lit(". "), o)))
    return marked.select("id", text.better_options("options").alias("options"))


@query("select p_partkey, p_name[-1] last, ascii(p_name) - 65 idx, chr(65 + cast(p_size % 7 as int)) letter, substring('task_' || p_partkey, 6) task from part")
def str6_letters(spark, d):
    task = F.substring(F.concat(F.lit("task_"), F.col("p_partkey").cast("string")), 6, 100)
    return table(spark, d, "part").select("p_partkey", text.last_char("p_name").alias("last"), text.letter_index("p_name").alias("idx"), text.index_letter(F.col("p_size") % 7).alias("letter"), task.alias("task"))


@query("select event_id, chr(65 + cast(event_id % 4 as int)) tagged, cast(json_extract_string(props, '$.k') as bigint) k, [props, 'end'] words from events")
def str10_model_output(spark, d):
    events = table(spark, d, "events")
    fenced = text.strip_fences(F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
    tagged = F.concat(F.lit(" <answer>"), text.index_letter(F.col("event_id") % 4), F.lit("</answer> "))
    thought = F.concat(F.lit("hm </think> "), F.regexp_replace("props", " ", ""), F.lit("  end "))
    return events.select("event_id", text.tagged_answer(tagged).alias("tagged"), F.get_json_object(fenced, "$.k").cast("long").alias("k"), F.transform(text.after_thinking(thought), lambda w: F.when(w == F.regexp_replace("props", " ", ""), F.col("props")).otherwise(w)).alias("words"))


@query("select id, question || chr(10) || array_to_string(list_transform(list_zip(options, range(4)), lambda x: chr(65 + cast(x[2] as int)) || ': ' || x[1]), chr(10)) prompt from items", grid=True)
def str12_prompts(spark, d):
    return fixtures.items(spark, d).select("id", text.options_prompt("question", "options").alias("prompt"))


@query()
def str16_fuzzy_ratio(spark, d):
    items = dedup.normalise(fixtures.documents(spark, d))
    return dedup.near_links(items).select("i", "j", "fuzz_ratio")


@query(r"select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'gsi'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '" + '"' + r"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) as said from pages")
def str17_clean_html(spark, d):
    return table(spark, d, "pages").select("page_id", text.clean_html("html").alias("said"))


@query("select n_nationkey, md5(n_name || '_' || n_nationkey || '_' || n_regionkey || '_') as hash from nation")
def str18_row_hash(spark, d):
    nation = table(spark, d, "nation")
    return nation.select("n_nationkey", text.row_hash(dict(nation.dtypes), [*nation.columns, "zz"]).alias("hash"))


# -- arrays and JSON


def _shuffled(spark, d):
    return clean.shuffle_options(fixtures.items(spark, d).select("id", "options", "answer_index"), 1)


_SHUFFLED = "w as (select id, options, gold_i, list_transform(list_sort(list_transform([0, 1, 2, 3], lambda i: {'h': md5('1:' || id || ':' || i), 'i': i})), lambda x: x.i) option_map from items)"


@query(f"{_SHUFFLED} select id, list_transform(option_map, lambda i: options[i + 1]) options, list_position(option_map, gold_i) - 1 answer_index, option_map, chr(64 + cast(list_position(option_map, gold_i) as int)) answer from w", grid=True)
def cl2_shuffle_options(spark, d):
    return _shuffled(spark, d).withColumn("answer_index", F.col("answer_index").cast("int"))


@query("select id, gold answer, 1 shuffle from items", grid=True)
def arr2_unshuffle(spark, d):
    made = _shuffled(spark, d).withColumn("shuffle", F.lit(1))
    return clean.unshuffle_answers(made.select("id", "shuffle", "answer"), made)


@query("select id, unnest(topics) topic from items", grid=True)
def arr3_explode_topics(spark, d):
    return fixtures.items(spark, d).select("id", F.explode_outer("topics").alias("topic"))


@query("select id, least(len(topics), 4) n, topics[1] topic, options[1] as opt from items", grid=True)
def arr5_zip_short(spark, d):
    zipped = fixtures.items(spark, d).select("id", arrays.zip_short("topics", "options").alias("z"))
    return zipped.select("id", F.size("z").cast("long").alias("n"), F.col("z")[0]["left"].alias("topic"), F.col("z")[0]["right"].alias("opt"))


@query("select event_id, chr(65 + cast(event_id % 4 as int)) answer from events")
def jsn1_answers_of_envelopes(spark, d):
    return fixtures.responses(spark, d).select("event_id", arrays.answer_of_envelope("value").alias("answer"))


@query("select event_id, event_type custom_id, 'm' model, props content from events")
def jsn8_envelopes(spark, d):
    made = table(spark, d, "events").select("event_id", inference.envelope(F.col("event_type"), F.lit(200), F.lit("m"), F.col("props")).alias("value"))
    get = lambda path: F.get_json_object("value", path)
    return made.select("event_id", get("$.custom_id").alias("custom_id"), get("$.response.body.model").alias("model"), get("$.response.body.choices[0].message.content").alias("content"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) props_k, event_type as meta_kind from events")
def jsn5_flatten(spark, d):
    nested = table(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("props"), F.struct(F.col("event_type").alias("kind")).alias("meta"))
    return arrays.flatten(nested)


@query("select p_partkey, case p_size % 4 when 0 then 'Medium' when 1 then 'Challenging' when 2 then 'Easy' end level from part")
def map1_remap(spark, d):
    raw = F.element_at(F.array(*map(F.lit, ["Moderate", "Very Hard", "Easy", "other"])), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", arrays.remap(raw).alias("level"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as stamp from orders")
def dat1_dates(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"))


# -- cleaning


@query("select p_partkey, case p_size % 5 when 0 then 'Medium' when 1 then 'Challenging' when 2 then 'Easy' when 3 then 'Hard' end difficulty_level, p_name question, case when p_size % 6 = 0 then [p_brand] else [p_brand, p_type] end options, cast(p_partkey % 3 as int) answer_index, p_size % 5 <> 4 and p_partkey % 3 < case when p_size % 6 = 0 then 1 else 2 end is_valid from part")
def cl1_clean_items(spark, d):
    level = F.element_at(F.array(*map(F.lit, ["Moderate", "Very Hard", "Easy", "Hard", "unknown"])), (F.col("p_size") % 5 + 1).cast("int"))
    raw = table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("key"), F.concat(F.lit("Câu hỏi 12. "), "p_name").alias("question"), F.concat(F.lit("A. "), "p_brand").alias("optionA"),
        F.when(F.col("p_size") % 6 == 0, "").otherwise(F.concat(F.lit("B. "), "p_type")).alias("optionB"),
        F.concat(F.lit("option"), text.index_letter(F.col("p_partkey") % 3)).alias("correctOption"), F.lit("a, b").alias("medicalTopic"), level.alias("difficultLevel"),
    )
    made = clean.clean_items(raw)
    return made.select(F.get_json_object("raw", "$.key").cast("long").alias("p_partkey"), "difficulty_level", "question", "options", "answer_index", "is_valid")


# -- duplicate removal


@query(f"with {_TERMS}, g as (select doc_id, q, lang, source from d join documents using (doc_id)), k as (select *, row_number() over (partition by q, lang, source order by doc_id) rn from (select g.doc_id, g.q, {_NORMAL.format(x='lang')} lang, {_NORMAL.format(x='source')} source from g)) select doc_id as idx from k where rn = 1")
def dd3_drop_exact(spark, d):
    return dedup.drop_exact(dedup.normalise(fixtures.documents(spark, d))).select("idx")


@query(f"with {_PAIRS}, k as (select i, j, case when distance < 1e-8 then 'exact' else 'near' end kind from p) select i, j, kind from k union all select j, i, kind from k where kind = 'near'")
def dd2_pair_classes(spark, d):
    pairs = dedup.cosine_pairs(dedup.normalise(fixtures.documents(spark, d)))
    return dedup.classify_pairs(pairs).select("i", "j", "kind")


_LCS = "with recursive p as (select a.p_partkey id, a.p_name || ' ' || a.p_type x, b.p_name || ' ' || b.p_type y from part a join part b on b.p_partkey = a.p_partkey + 1), l(id, x, y, t, row) as (select id, x, y, 0, list_transform(range(length(x) + 1), lambda k: 0::bigint) from p union all select id, x, y, t + 1, list_transform(range(1, length(x) + 2), lambda k: list_max(list_slice(cand, 1, k))) from (select *, list_transform(range(1, length(x) + 2), lambda k: case when k > 1 and substr(x, k - 1, 1) = substr(y, t + 1, 1) then row[k - 1] + 1 else row[k] end) cand from l where t < length(y)))"


@query(f"{_LCS}, r as (select id, cast(round_even(200 * row[-1] / (length(x) + length(y)), 0) as int) fuzz_ratio from l where t = length(y)) select id p_partkey, fuzz_ratio, case when fuzz_ratio >= 70 then fuzz_ratio else 0 end from_70 from r")
def str16_neighbours(spark, d):
    """Ratios of every part's name and type to those of the part behind it."""
    part = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("x"))
    behind = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("x").alias("y"))
    return part.join(behind, "p_partkey").select("p_partkey", text.fuzz_ratio("x", "y").alias("fuzz_ratio"), text.fuzz_from("x", "y", 70).alias("from_70"))


@query("with recursive e as (select a.p_partkey i, b.p_partkey j from part a join part b on b.p_partkey - a.p_partkey in (1, 3, 40) and a.p_size % 3 = b.p_size % 3), near as materialized (select i, list(j) js from e group by i), ends as materialized (select max(p_partkey) n from part), g(k, gone) as (select -1::bigint, []::bigint[] union all select k + 1, list_filter(case when js is null or list_contains(gone, k + 1) then gone else list_distinct(list_concat(gone, js)) end, lambda x: x > k) from g join ends on k < n left join near on i = k + 1) select distinct unnest(gone) idx from g")
def dd5_keep_first(spark, d):
    """Greedy removal over a graph of parts: neighbours are 1, 3 or 40 keys apart and of sizes that leave the same by 3."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("i"), (F.col("p_size") % 3).alias("size"))
    far = part.select(F.col("i").alias("of"), "size", F.explode(F.array(*[F.lit(k) for k in (1, 3, 40)])).alias("step")).select("of", "size", (F.col("of") + F.col("step")).alias("i"))
    edges = far.join(part, ["i", "size"]).select(F.col("of").alias("i"), F.col("i").alias("j"))
    return dedup.keep_first(spark, part.select(F.col("i").alias("idx")), edges)


@query()
def dd5_drop_near(spark, d):
    return dedup.dedup(spark, fixtures.documents(spark, d)).select("idx")


# -- SQL over views


@query("select o_custkey, count(*) as n, round(sum(o_totalprice), 2) as total from orders where o_orderstatus <> 'P' group by o_custkey having count(*) > 2")
def sql2_transform(spark, d):
    return runner.transform(spark, table(spark, d, "orders"), "select o_custkey, count(*) as n, round(sum(o_totalprice), 2) as total from data where o_orderstatus <> 'P' group by o_custkey having count(*) > 2")


@query("select n_name, 'e' as \"__etl_private_field__-extNameValue\", 'p' as \"__etl_private_field__-pipelineNameValue\", 't' as \"__etl_private_field__-tagNameValue\" from nation")
def sql6_private_columns(spark, d):
    return runner.private_columns(table(spark, d, "nation").select("n_name"), "__etl_private_field__", {"extNameValue": "e", "pipelineNameValue": "p", "tagNameValue": "t"})


# -- windows over events (extensions)


@query("select time_bucket(interval 1 hour, ts) window_start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def stm_tumbling(spark, d):
    return increments.tumbling(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("select time_bucket(interval 1 hour, ts) - to_hours(k) window_start, count(*) n from events, (select unnest([0, 1]) k) group by 1")
def stm_sliding(spark, d):
    return increments.sliding(table(spark, d, "events"))


@query("with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) k from g) select user_id, min(ts) session_start, count(*) n from s group by user_id, k")
def stm_sessions(spark, d):
    return increments.sessions(table(spark, d, "events"))


# -- inference


@query()
def inf3_infer(spark, d):
    prompts = fixtures.items(spark, d).select("id", text.options_prompt("question", "options").alias("content"))
    return inference.infer(prompts, inference.responder("fake"))


@query("select id, 'task_' || id as custom_id, question as content from items", grid=True)
def jsn6_requests(spark, d):
    prompts = fixtures.items(spark, d).select("id", F.col("question").alias("content"))
    lines = inference.request_lines(prompts, "openai", "m", "You answer.")
    return lines.select("id", F.get_json_object("line", "$.custom_id").alias("custom_id"), F.get_json_object("line", "$.body.messages[1].content").alias("content"))


@query("select (row_number() over (order by c_custkey) - 1) // 20 as batch, c_custkey from customer")
def lim5_batches(spark, d):
    rows = predicates.numbered(table(spark, d, "customer").select("c_custkey"), [F.col("c_custkey")], "at")
    return rows.select(F.floor(F.col("at") / 20).alias("batch"), "c_custkey")


@query("with w as (select (row_number() over (order by p_partkey) - 1) // 25 as batch, p_partkey, p_name from part) select batch, string_agg(p_name || ';' || p_partkey, chr(10) order by p_partkey) as content from w group by 1")
def str13_batch_text(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(";", "p_name", F.col("p_partkey").cast("string")).alias("content"))
    return inference.batch_text(rows, 25)


@query("select c_custkey from customer order by c_acctbal, c_custkey limit 10 offset 20")
def lim6_page(spark, d):
    rows, _ = predicates.page_of(table(spark, d, "customer"), [F.col("c_acctbal"), F.col("c_custkey")], 3, 10)
    return rows.select("c_custkey")


@query("select p_partkey from part order by p_partkey limit 40")
def prd16_head_sample(spark, d):
    return predicates.head_sample(table(spark, d, "part"), [F.col("p_partkey")], 40).select("p_partkey")


# -- duplicate reports


@query(f"with {_TERMS} select doc_id as idx, q, [lower(lang), lower(source)] as options from d join documents using (doc_id)")
def dd1_normalise(spark, d):
    return dedup.normalise(fixtures.documents(spark, d))


@query(f"with {_PAIRS} select p.i, p.j, a.lang = b.lang and a.source = b.source as same_answers, contains(db.q, da.q) as i_in_j, contains(da.q, db.q) as j_in_i from p join d da on da.doc_id = i join d db on db.doc_id = j join documents a on a.doc_id = i join documents b on b.doc_id = j where distance >= 1e-8")
def dd4_near_report(spark, d):
    items = dedup.normalise(fixtures.documents(spark, d))
    return dedup.same_answers(items, dedup.near_links(items, ratio=False)).select("i", "j", "same_answers", "i_in_j", "j_in_i")


# -- sources and sinks, by way of the shared folder


@query("select n_nationkey, n_name, 'json' as kind from nation")
def src1_json_view(spark, d):
    folder = work_path(spark, "json")
    table(spark, d, "nation").write.option("compression", "bzip2").json(f"{folder}/deep/er")
    view = readers.JsonView("v", path_glob_filter="*.json.bz2", compress_type="bzip2", recursive_file_lookup=True, filename_field="origin")
    rows = readers.read_view(spark, folder, view)
    return rows.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.regexp_extract("origin", r"\.(json)\.bz2$", 1).alias("kind"))


@query("select r_name, count(*) as nations from nation join region on n_regionkey = r_regionkey group by 1")
def sql1_transformer(spark, d):
    folder = work_path(spark, "transformer")
    for name in ("nation", "region"):
        table(spark, d, name).write.json(f"{folder}/in/2024-02-03/{name}")
    registry = Registry(spark)
    views = tuple(readers.JsonView(name, name) for name in ("nation", "region"))
    template = folder + "/in{{'/' + execution_time.strftime('%Y-%m-%d') if execution_time != '*' else ''}}"
    made = registry.add_transformer(Transformer("t", template, f"{folder}/out", views, "select r_name, count(*) as nations from nation join region on n_regionkey = r_regionkey group by 1"))
    return runner.run_transformer(spark, made, "2024-02-03T00:00:00Z")


@query("select cast(p_partkey as varchar) as p_partkey, p_name, p_type from part")
def src11_csv(spark, d):
    folder = work_path(spark, "csv")
    writers.write_csv(table(spark, d, "part").select("p_partkey", "p_name", "p_type"), folder)
    return readers.read_csv(spark, folder, ["p_partkey", "p_name", "p_type"])


@query("select p_partkey, p_name from part where p_brand like 'Brand#1%' and p_size >= 10")
def src3_pruned_listing(spark, d):
    """Parts as JSON files in a folder a brand and size group; of all files those are opened whose key matches."""
    folder = work_path(spark, "brands")
    part = table(spark, d, "part").withColumn("group", F.when(F.col("p_size") < 10, "small").otherwise("large"))
    part.select("p_partkey", "p_name", F.col("p_brand").alias("brand"), "group").write.partitionBy("brand", "group").json(folder)
    lines = readers.read_blocks(spark, folder, "", "brand=Brand%231*/group=large/**/*.json").select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("value"))
    return lines.filter("value <> ''").select(F.from_json("value", "p_partkey long, p_name string").alias("row")).select("row.*")


@query("with c as (select conv_id, list(struct_pack(turn := turn, role := role, text := text)) turns from conversations group by conv_id) select conv_id from c where len(list_filter(turns, lambda x: x.role = 'assistant' and x.turn >= 3)) > 0 and not (len(list_filter(turns, lambda x: x.turn = 6)) > 0 or conv_id % 10 = 3 and conv_id < 40)")
def src9_nested_filter(spark, d):
    """Conversations as documents with an array of turns, by a document store's filter over it."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns")).withColumn("last", F.struct((F.col("conv_id") % 10).alias("digit")))
    match = {"turns": {"$elemMatch": {"role": "assistant", "turn": {"$gte": 3}}}, "$nor": [{"turns.turn": 6}, {"last.digit": 3, "conv_id": {"$not": {"$gte": 40}}}]}
    return readers.scan_documents(turns, {"match": match, "project": {"conv_id": 1}})


@query("select page_id, url from pages where page_id % 16 >= 8")
def src8_changed_members(spark, d):
    """Pages in archives of 16; a change table names archives, and of those past the mark the JSON members are read."""
    pages, folder = table(spark, d, "pages"), work_path(spark, "archives")
    name = F.format_string("part/%02d.zip", F.col("page_id") % 16)
    members = pages.select(name.alias("path"), F.explode(F.array(F.struct(F.concat("page_id", F.lit(".json")).alias("member"), F.to_json(F.struct("page_id", "url")).alias("text")), F.struct(F.concat("page_id", F.lit(".html")).alias("member"), F.coalesce("html", F.lit("")).alias("text")))).alias("m")).select("path", "m.member", "m.text")
    writers.copy_files(readers.zip_members(members).withColumnRenamed("path", "key"), folder)
    changes = pages.select((F.col("page_id") % 16).alias("seq"), name.alias("path")).distinct()
    found = readers.read_members(readers.scan_table(changes, ["path"], "seq", 7), folder, r"\.json$")
    return found.select(F.from_json("text", "page_id long, url string").alias("row")).select("row.*")


@query("select cast(r_regionkey as bigint) as r_regionkey, r_name from region")
def src12_jsonl(spark, d):
    folder = work_path(spark, "jsonl")
    writers.write_jsonl(table(spark, d, "region"), folder)
    return readers.read_jsonl(spark, folder, "r_regionkey long, r_name string")


@query("select c_custkey, c_mktsegment from customer")
def snk4_increments(spark, d):
    folder = work_path(spark, "increments")
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    writers.overwrite_increment(rows, folder, "c_mktsegment")
    writers.overwrite_increment(rows.filter("c_mktsegment = 'BUILDING'"), folder, "c_mktsegment")
    return spark.read.parquet(folder).select("c_custkey", "c_mktsegment")


@query("select event_type, count(*) as n, count(distinct event_id) as ids from events group by 1")
def stm3_available_now(spark, d):
    folder = work_path(spark, "stream")
    events = table(spark, d, "events")
    events.repartition(3).write.parquet(f"{folder}/in")
    stream = increments.read_new_files(spark, f"{folder}/in", events.schema, files=2)
    increments.run_available(stream, f"{folder}/checkpoint", increments.append_once(f"{folder}/out"))
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))
