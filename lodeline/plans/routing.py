"""Queries of rules: lexicons, routes, curated answers, cascades, entities, guardrails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodeline.functions import rules
from lodeline.functions.text import normalise
from lodeline.plans.registry import query
from lodeline.session import table

LEXICON = {0: {"thinner": 5, "than": 2, "worthless": 7}, 1: {"then": 3, "inor": 2, "with": 1}, 2: {"les": 4, "avec": 5}, 3: {"nicht": 6, "der": 2}, 4: {"que": 3, "las": 2}}
ROUTES = [(0, ["with", "than", "inor"], "a0"), (1, ["then"], "a1"), (2, ["then", "this"], "a2"), (3, ["les", "de"], "a3"), (4, ["der"], "a4"), (5, ["is"], "a5")]
CURATED = [(0, "To ", "c0"), (1, "Was of. Enerth thedouhe.", "c1"), (2, "en ", "c2")]
TURN = "conv_id * 1000 + turn"


def turns(spark: SparkSession, sf_dir: str, role: str = "user") -> DataFrame:
    """Turns of conversations with one id each."""
    return table(spark, sf_dir, "conversations").where(F.col("role") == role).select(F.expr(TURN).alias("qid"), "text")


_U = f"u AS (SELECT {TURN} AS qid, text, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS norm FROM conversations WHERE role = 'user')"
_LEX = _U + ", lx(label, kw, w) AS (VALUES " + ", ".join(f"({a}, '{k}', {float(w)})" for a, d in LEXICON.items() for k, w in d.items()) + "), lab AS (SELECT DISTINCT label FROM lx), sc AS (SELECT u.qid, lab.label, coalesce(sum(w) FILTER (contains(norm, kw)), 0.0)::DOUBLE AS score FROM u, lab JOIN lx USING (label) GROUP BY ALL)"


@query(f"WITH {_LEX} SELECT qid, label::INT AS label, score FROM sc")
def lexicon_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.lexicon_scores(turns(spark, sf_dir), rules.lexicon(spark, LEXICON), list(LEXICON), "qid", "text")


@query(f"WITH {_LEX} SELECT qid, label::INT AS label, score, round(CASE WHEN t > 0 THEN score / t ELSE 0 END, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, label) AS n, sum(greatest(score, 0)) OVER (PARTITION BY qid) AS t FROM sc) WHERE n = 1")
def lexicon_argmax_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.argmax_label(lexicon_score(spark, sf_dir), "qid").withColumn("confidence", F.round("confidence", 6))


def _routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROUTES, "priority int, keywords array<string>, answer string")


_RT = "rt(priority, kws, answer) AS (VALUES " + ", ".join(f"({p}, [{', '.join(repr(k) for k in ks)}], '{a}')" for p, ks, a in ROUTES) + ")"
_FIRST = "fr AS (SELECT qid, priority, answer FROM (SELECT qid, priority, answer, row_number() OVER (PARTITION BY qid ORDER BY priority) AS n FROM u, rt WHERE len(list_filter(kws, lambda k: contains(text, k))) = len(kws)) WHERE n = 1)"


@query(f"WITH {_U}, {_RT}, {_FIRST} SELECT qid, priority, answer FROM fr")
def route_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.first_route(turns(spark, sf_dir), _routes(spark), "qid", "text")


@query("""WITH rt AS (SELECT p_partkey AS priority, list_filter(string_split(p_name, ' '), lambda w: w <> '')[1:1 + p_partkey % 3] AS kws FROM part)
SELECT a.priority, min(b.priority) AS blocked_by FROM rt a JOIN rt b ON b.priority < a.priority AND len(list_filter(b.kws, lambda k: len(list_filter(a.kws, lambda o: contains(o, k))) > 0)) = len(b.kws) GROUP BY a.priority""")
def shadowed_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes by the first words of the parts' names."""
    words = F.filter(F.split("p_name", " "), lambda w: w != "")
    return rules.shadowed_routes(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("priority"), F.slice(words, F.lit(1), (1 + F.col("p_partkey") % 3).cast("int")).alias("keywords")))


_CU = "cu(ord, question, answer) AS (VALUES " + ", ".join(f"({o}, '{q}', '{a}')" for o, q, a in CURATED) + ")"
_NEAR = "nr AS (SELECT qid, ord, answer FROM (SELECT qid, ord, answer, row_number() OVER (PARTITION BY qid ORDER BY ord) AS n FROM u JOIN cu ON contains(text, question) OR contains(question, text)) WHERE n = 1)"


def _curated(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CURATED, "ord int, question string, answer string")


@query(f"WITH {_U}, {_CU}, {_NEAR} SELECT qid, ord, answer FROM nr")
def substring_bidirectional_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.either_contains(turns(spark, sf_dir), _curated(spark), "qid", "text")


@query(f"WITH {_U}, {_RT}, {_FIRST}, {_CU}, {_NEAR}, ex AS (SELECT qid, min_by(answer, ord) AS answer FROM u JOIN cu ON text = question GROUP BY qid) SELECT u.qid, coalesce(ex.answer, fr.answer, nr.answer) AS answer, CASE WHEN ex.answer IS NOT NULL THEN 'exact' WHEN fr.answer IS NOT NULL THEN 'route' WHEN nr.answer IS NOT NULL THEN 'near' END AS how FROM u LEFT JOIN ex USING (qid) LEFT JOIN fr USING (qid) LEFT JOIN nr USING (qid)")
def curated_answer_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.curated(turns(spark, sf_dir), _curated(spark), _routes(spark), "qid", "text")


CASCADE = [rules.Rule(4, (("thinner", "whtion"), ("the", "of"))), rules.Rule(2, (("avec", "dans"),), ("que",)), rules.Rule(3, (("nicht", "auf", "der"), ("und", "die"))), rules.Rule(1, (("hation", "inge"),), ("shuttle",)), rules.Rule(0, (("with",),), ("then", "than"))]


def _cascade_sql() -> str:
    any_ = lambda ws: "(" + " OR ".join(f"contains(norm, '{w}')" for w in ws) + ")"
    return "CASE " + " ".join("WHEN " + " AND ".join([any_(g) for g in r.groups] + [f"NOT contains(norm, '{w}')" for w in r.none_of]) + f" THEN {r.label}" for r in CASCADE) + " END"


@query(f"WITH {_U} SELECT qid, {_cascade_sql()} AS label FROM u")
def override_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("qid", rules.cascade(normalise(F.col("text")), CASCADE).alias("label"))


ALIASES = {"dept": {"d1": ["than the", "inor"], "d2": ["hation"]}, "stop": {"s1": ["wh er", "of the"], "s2": ["and"]}}
ENTITIES = rules.Entities(ALIASES, {"dept": ("c0", "c1"), "stop": ("c2",)})


def _alias_sql(name: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(flat, '{a.replace(' ', '')}')" for a in al) + f" THEN '{c}'" for c, al in ALIASES[name].items()) + " END"


@query(f"WITH e AS (SELECT {TURN} AS qid, 'c' || (conv_id % 3) AS cat, replace(text, ' ', '') AS flat FROM conversations WHERE role = 'user') SELECT qid, CASE WHEN cat IN ('c0', 'c1') THEN {_alias_sql('dept')} END AS dept, CASE WHEN cat = 'c2' THEN {_alias_sql('stop')} END AS stop FROM e")
def alias_entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = turns(spark, sf_dir).withColumn("cat", F.concat(F.lit("c"), (F.floor(F.col("qid") / 1000) % 3).cast("string")))
    return q.select("qid", ENTITIES.extract(F.col("text"), F.col("cat")).alias("e")).select("qid", "e.dept", "e.stop")


@query(f"WITH {_U}, f AS (SELECT qid, norm, replace(norm, ' ', '') AS flat FROM u) SELECT qid, CASE WHEN " + " OR ".join(f"contains(flat, '{w}')" for w in rules.GREETINGS) + " OR " + " OR ".join(f"contains(norm, '{w}')" for w in rules.HELP) + " THEN 'greeting' WHEN NOT (contains(flat, 'thinner') OR contains(flat, 'inorthe')) THEN 'off' END AS canned FROM f")
def guardrail_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("qid", rules.guardrail(F.col("text"), ("thinner", "inor the"), "greeting", "off").alias("canned"))
