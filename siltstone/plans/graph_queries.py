"""Queries of label hierarchies and classification metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..operators import stats
from . import views as V
from .common import Registry, d6, r6

R = Registry()

_UP = "up(ancestor, descendant, steps) AS (SELECT DISTINCT c, c, 0 FROM (SELECT child AS c FROM edges UNION ALL SELECT parent FROM edges) UNION ALL SELECT e.parent, up.descendant, up.steps + 1 FROM up JOIN edges e ON e.child = up.ancestor)"
_CL = "cl AS (SELECT ancestor, descendant, max(steps) AS steps FROM up GROUP BY ALL)"
#: Probabilities: class k of the sorted classes takes component k of an embedding.
_PROB = "nm AS (SELECT class, row_number() OVER (ORDER BY class) - 1 AS i FROM (SELECT child AS class FROM edges UNION SELECT parent FROM edges)), pr AS (SELECT vec_id AS row_id, class, 1/(1+exp(-8*v)) AS p FROM emb JOIN nm ON nm.i = emb.i)"
_LAB = "lb AS (SELECT row_id, class, CAST(p > 0.5 AS INT) AS p FROM pr)"


def _h(name: str, sql: str, doubles: list[str], make, *views: str):
    text = V.with_views(sql, *(views or ("edges",)))
    R.add(name, d6(text, *doubles) if doubles else text)(lambda s, d: r6(make(s, d)))


def _prob(s, d):
    e = V.edges(s, d)
    # at most a few dozen classes: their names are a literal list
    names = sorted(r[0] for r in e.select("child").union(e.select("parent")).distinct().collect())
    table = s.createDataFrame(list(enumerate(names)), "i int, class string")
    p = V.emb(s, d).join(F.broadcast(table), "i")
    return p.select(F.col("vec_id").alias("row_id"), "class", (1 / (1 + F.exp(-8 * F.col("v")))).alias("p"))


def _hard(s, d):
    return _prob(s, d).withColumn("p", (F.col("p") > 0.5).cast("int"))


_P = ("edges", "emb")
_h("hier_depth", f"WITH RECURSIVE {_UP} SELECT descendant AS class, CAST(max(steps) AS INT) AS depth FROM up GROUP BY 1", [], lambda s, d: H.depths(V.edges(s, d)))
_h("hier_adj", "WITH c AS (SELECT child AS class FROM edges UNION SELECT parent FROM edges) SELECT class, coalesce((SELECT string_agg(parent, ',' ORDER BY parent) FROM edges WHERE child = class), '') AS parents, coalesce((SELECT string_agg(child, ',' ORDER BY child) FROM edges WHERE parent = class), '') AS children FROM c", [], lambda s, d: H.adjacency(V.edges(s, d)).select("class", F.array_join("parents", ",").alias("parents"), F.array_join("children", ",").alias("children")))
_h("agg_dag_stats", f"WITH RECURSIVE {_UP}, dp AS (SELECT descendant AS class, max(steps) AS depth FROM up GROUP BY 1) SELECT count(*) AS classes, CAST(max(depth) AS INT) AS max_depth, avg(depth) AS mean_depth, (SELECT count(*) FROM edges) AS edges, count(*) FILTER (class NOT IN (SELECT child FROM edges)) AS roots, count(*) FILTER (class NOT IN (SELECT parent FROM edges)) AS leaves FROM dp", ["mean_depth"], lambda s, d: H.dag_stats(V.edges(s, d)))
_PROP = f"WITH RECURSIVE {_UP}, {_CL}, {_PROB} SELECT pr.row_id, {{to}} AS class, {{f}}(p) AS p FROM pr JOIN cl ON pr.class = {{of}} GROUP BY ALL"
_h("hier_up_max", _PROP.format(to="ancestor", of="descendant", f="max"), ["p"], lambda s, d: H.propagated(_prob(s, d), V.edges(s, d), "up"), *_P)
_h("hier_down_min", _PROP.format(to="descendant", of="ancestor", f="min"), ["p"], lambda s, d: H.propagated(_prob(s, d), V.edges(s, d), "down"), *_P)
_h("hier_bidir", _PROP.format(to="descendant", of="ancestor", f="min"), ["p"], lambda s, d: H.propagated(H.propagated(_prob(s, d), V.edges(s, d), "down"), V.edges(s, d), "up"), *_P)
_h("hier_repair", f"WITH RECURSIVE {_UP}, {_CL}, {_PROB}, {_LAB} SELECT lb.row_id, ancestor AS class, max(p) AS p FROM lb JOIN cl ON lb.class = descendant GROUP BY ALL", [], lambda s, d: H.repaired(_hard(s, d), V.edges(s, d)), *_P)
_VIOL = "SELECT count(*) FILTER (c.p = 1 AND q.p = 0) AS violations, 100.0::DOUBLE*count(DISTINCT c.row_id) FILTER (c.p = 1 AND q.p = 0)/(SELECT count(DISTINCT row_id) FROM {t}) AS percent_rows FROM edges e JOIN {t} c ON c.class = e.child JOIN {t} q ON q.class = e.parent AND q.row_id = c.row_id"
_h("agg_violations", f"WITH {_PROB}, {_LAB} {_VIOL.format(t='lb')}", ["percent_rows"], lambda s, d: H.violations(_hard(s, d), V.edges(s, d)), *_P)
_h("hier_assert", f"WITH RECURSIVE {_UP}, {_CL}, {_PROB}, {_LAB}, rp AS (SELECT lb.row_id, ancestor AS class, max(p) AS p FROM lb JOIN cl ON lb.class = descendant GROUP BY ALL) {_VIOL.format(t='rp')}", ["percent_rows"], lambda s, d: H.violations(H.repaired(_hard(s, d), V.edges(s, d)), V.edges(s, d)), *_P)
_h("join_edge_prob", f"WITH {_PROB} SELECT c.row_id, e.child, e.parent, c.p AS p_child, q.p AS p_parent FROM edges e JOIN pr c ON c.class = e.child JOIN pr q ON q.class = e.parent AND q.row_id = c.row_id", ["p_child", "p_parent"], lambda s, d: H.edge_values(_prob(s, d), V.edges(s, d)), *_P)
_h("agg_hier_reg", f"WITH {_PROB} SELECT avg(greatest(c.p - q.p, 0)) AS penalty FROM edges e JOIN pr c ON c.class = e.child JOIN pr q ON q.class = e.parent AND q.row_id = c.row_id", ["penalty"], lambda s, d: H.hierarchy_penalty(_prob(s, d), V.edges(s, d)), *_P)
_BOTH = f"WITH RECURSIVE {_UP}, {_CL}, {_PROB}, dn AS (SELECT row_id, descendant AS class, CAST(min(p) > 0.5 AS INT) AS p FROM pr JOIN cl ON pr.class = ancestor GROUP BY ALL), uu AS (SELECT row_id, ancestor AS class, CAST(max(p) > 0.5 AS INT) AS p FROM pr JOIN cl ON pr.class = descendant GROUP BY ALL)"
_h("hier_compare", f"{_BOTH} SELECT CAST(k AS INT) AS place, m AS method, violations, percent_rows FROM (SELECT 0 AS k, 'top_down' AS m, * FROM ({_VIOL.format(t='dn')}) UNION ALL SELECT 1, 'bottom_up', * FROM ({_VIOL.format(t='uu')}) UNION ALL SELECT 2, 'bidirectional', * FROM ({_VIOL.format(t='dn')}))", ["percent_rows"], lambda s, d: H.compared(_prob(s, d), V.edges(s, d)), *_P)
_h("join_semi_edges", "SELECT child, parent FROM edges WHERE child IN (SELECT n_name FROM nation) AND parent IN (SELECT r_name FROM region)", [], lambda s, d: V.edges(s, d).join(F.broadcast(V.table(s, d, "nation").select(F.col("n_name").alias("child"))), "child", "left_semi").join(F.broadcast(V.table(s, d, "region").select(F.col("r_name").alias("parent"))), "parent", "left_semi").select("child", "parent"))
_h(
    "src_obo",
    "SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 4",
    [],
    lambda s, d: _obo(s, d),
    "edges",
)


def _obo(s, d):
    """Nations as ontology terms, three lines each, read back with nations and regions as targets."""
    n = V.table(s, d, "nation").join(F.broadcast(V.table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    three = F.array(F.lit("[Term]"), F.concat(F.lit("id: "), "n_name"), F.concat(F.lit("is_a: "), "r_name", F.lit(" ! region")))
    lines = n.select(F.posexplode(three).alias("k", "line"), "n_nationkey").select((F.col("n_nationkey") * 3 + F.col("k")).alias("n"), "line")
    targets = V.table(s, d, "nation").where("n_nationkey % 5 <> 4").select(F.col("n_name").alias("class")).union(V.table(s, d, "region").select("r_name"))
    return H.obo_edges(lines, targets)


R.add("win_carry", R.sql["src_obo"])(lambda s, d: _obo(s, d))


@R.add("hier_tiebreak")
def hier_tiebreak(s, d):
    e = V.edges(s, d).withColumn("n", F.hash("child", "parent"))
    return H.tie_broken(_prob(s, d).withColumn("label", (F.col("p") > 0.5).cast("int")), e)


# metrics over labels; a prediction is a rule on doc_id

_LBL = "u AS (SELECT doc_id, 'quality' AS class, quality AS y, CAST(doc_id % 3 = 0 AS INT) AS p, doc_id % 100 / 100.0::DOUBLE AS q FROM labels UNION ALL SELECT doc_id, 'toxic', toxic, CAST(doc_id % 3 = 0 AS INT), doc_id % 100 / 100.0::DOUBLE FROM labels)"


def _labels(s, d):
    x = stats.unpivoted(V.table(s, d, "labels"), ["doc_id"], ["quality", "toxic"], "class", "y")
    return x.withColumn("p", (F.col("doc_id") % 3 == 0).cast("int")).withColumn("q", F.col("doc_id") % 100 / 100.0)


@R.add("agg_macro_f1", d6(f"WITH {_LBL}, c AS (SELECT class, count(*) FILTER (y=1 AND p=1) AS tp, count(*) FILTER (y=0 AND p=1) AS fp, count(*) FILTER (y=1 AND p=0) AS fn FROM u GROUP BY 1) SELECT avg(coalesce(2.0::DOUBLE*tp/nullif(2*tp+fp+fn,0),0)) AS macro_f1 FROM c", "macro_f1"))
def agg_macro_f1(s, d):
    return r6(stats.macro_f1(_labels(s, d)))


@R.add("agg_posweight", d6(f"WITH {_LBL}, c AS (SELECT class, sqrt((count(*)-sum(y)+1e-6)/(sum(y)+1e-6)) AS w FROM u GROUP BY 1) SELECT class, least(greatest(w, 1), 20) AS weight FROM c", "weight"))
def agg_posweight(s, d):
    return r6(stats.positive_weights(_labels(s, d).select("class", F.col("y").alias("value"))))


@R.add("agg_focal", d6(f"WITH {_LBL}, z AS (SELECT y, CASE WHEN y = 1 THEN c ELSE 1-c END AS r FROM (SELECT y, greatest(1e-6, least(1-1e-6, q)) AS c FROM u)) SELECT avg((CASE WHEN y = 1 THEN 0.5 ELSE 0.5 END)*power(1-r, 1.0)*-ln(r)*(CASE WHEN y = 1 THEN 2.0 ELSE 1.0 END)) AS loss FROM z", "loss"))
def agg_focal(s, d):
    return r6(_labels(s, d).agg(F.avg(stats.focal_loss(F.col("y"), F.col("q"), F.lit(2.0))).alias("loss")))


@R.add("join_exclude_bad", "SELECT d.doc_id, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_exclude_bad(s, d):
    return V.table(s, d, "documents").select("doc_id").join(V.table(s, d, "labels").select("doc_id", "toxic"), "doc_id", "left").select("doc_id", F.coalesce("toxic", F.lit(0)).alias("toxic"))


@R.add("flt_valid_smiles", "SELECT p_partkey AS row_id, p_size > 10 AND p_type LIKE '%S%' AS valid FROM part")
def flt_valid_smiles(s, d):
    """Rows parted by a parser's verdict with their places kept; here the parser is a rule on part names."""
    return V.table(s, d, "part").select(F.col("p_partkey").alias("row_id"), ((F.col("p_size") > 10) & F.col("p_type").like("%S%")).alias("valid"))


_BOND = "b AS (SELECT l_orderkey AS g, l_partkey % 7 AS u, l_suppkey % 7 AS v FROM lineitem WHERE l_partkey % 7 <> l_suppkey % 7), dg AS (SELECT g, a, count(*) AS deg FROM (SELECT g, u AS a FROM b UNION ALL SELECT g, v FROM b) GROUP BY ALL)"


@R.add("prj_zagreb", f"WITH {_BOND}, f AS (SELECT g, CAST(sum(deg*deg) AS BIGINT) AS first FROM dg GROUP BY 1), s AS (SELECT b.g, CAST(sum(x.deg*y.deg) AS BIGINT) AS second FROM b JOIN dg x ON x.g = b.g AND x.a = b.u JOIN dg y ON y.g = b.g AND y.a = b.v GROUP BY 1) SELECT f.g, first, second FROM f JOIN s ON f.g = s.g")
def prj_zagreb(s, d):
    b = V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("g"), (F.col("l_partkey") % 7).alias("u"), (F.col("l_suppkey") % 7).alias("v")).where("u <> v")
    deg = b.select("g", F.explode(F.array("u", "v")).alias("a")).groupBy("g", "a").agg(F.count("*").alias("deg"))
    first = deg.groupBy("g").agg(F.sum(F.col("deg") * F.col("deg")).alias("first"))
    ends = lambda c, n: deg.select("g", F.col("a").alias(c), F.col("deg").alias(n))
    second = b.join(ends("u", "x"), ["g", "u"]).join(ends("v", "y"), ["g", "v"]).groupBy("g").agg(F.sum(F.col("x") * F.col("y")).alias("second"))
    return first.join(second, "g")


@R.add("prj_elem_count", "SELECT l_orderkey AS g, count(*) FILTER (l_linenumber = 1) AS c, count(*) FILTER (l_linenumber = 2) AS n, count(*) FILTER (l_linenumber > 2) AS o FROM lineitem GROUP BY 1")
def prj_elem_count(s, d):
    k = F.col("l_linenumber")
    return V.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("g")).agg(F.count_if(k == 1).alias("c"), F.count_if(k == 2).alias("n"), F.count_if(k > 2).alias("o"))


@R.add("prj_lipinski", "SELECT p_partkey, p_retailprice <= 1200 AND p_size <= 25 AND length(p_name) <= 40 AND length(p_type) <= 30 AS ok FROM part")
def prj_lipinski(s, d):
    """All of four upper bounds."""
    p = V.table(s, d, "part")
    return p.select("p_partkey", ((F.col("p_retailprice") <= 1200) & (F.col("p_size") <= 25) & (F.char_length("p_name") <= 40) & (F.char_length("p_type") <= 30)).alias("ok"))
