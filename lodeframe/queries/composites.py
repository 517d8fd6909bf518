"""Composites, the cross-sectional model, evaluation summaries, refresh by stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.columns import tidy
from lodeframe.operators import portfolio, transforms
from lodeframe.plans import composites, evaluate
from lodeframe.plans.panels import Panels
from lodeframe.plans.together import Test, Together, run_together
from lodeframe.queries import query, r
from lodeframe.queries.ics import IC, LONG, NW, RET, base, ics_of
from lodeframe.queries.loading import _D, _FEASIBLE, store
from lodeframe.queries.portfolios import _G, _ROWS, _SINGLE, bucket, single
from lodeframe.session import kept, scratch_path
from lodeframe.sources.store import FactorStore
from lodeframe.streaming.refresh import upsert_stream

FACTORS = ["price", "volume", "disc"]
_W = """wt AS (
  SELECT date, factor, lag(CASE WHEN c >= 6 THEN m END) OVER (PARTITION BY factor ORDER BY date) AS w
  FROM (SELECT date, factor, avg(ic) OVER q AS m, count(ic) OVER q AS c FROM ics WINDOW q AS (PARTITION BY factor ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) AS x)"""


class Plain(composites.IcComposer):
    """IC composer without z-scores, as a Composer subclass (F2)."""


@query("SELECT a.date, a.code, a.price, a.volume, r.ret FROM factor_a AS a JOIN (SELECT date, code, lead(cap, 2) OVER (PARTITION BY code ORDER BY date) / nullif(lead(cap, 1) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS ret FROM factor_b) AS r ON r.date = a.date AND r.code = a.code")
def load_xy_aligned(p: Panels) -> DataFrame:
    """Factors and forward returns on common keys."""
    c = composites.Composer(store(p, "factor_a", "factor_b"), ["factor_a/price", "factor_a/volume"], "factor_b/cap", window=12)
    return c.align(c.load_x(), c.load_y())


@query(f"SELECT date, factor, {r('w', 'weight')} FROM wt", RET, LONG, IC, _W)
def ic_weights(p: Panels) -> DataFrame:
    """Rolling mean IC of twelve dates, one date late."""
    return composites.rolling_ic_weights(ics_of(p), 12, 6).select("date", "factor", tidy("weight").alias("weight"))


@query(f"SELECT long_.date, long_.code, {r('sum(CASE WHEN x IS NOT NULL THEN w * x END) / nullif(sum(CASE WHEN x IS NOT NULL THEN abs(w) END), 0)', 'target')} FROM long_ LEFT JOIN wt ON wt.date = long_.date AND wt.factor = long_.factor GROUP BY 1, 2", RET, LONG, IC, _W,
       "long_ AS (SELECT date, code, 'price' AS factor, CAST(price AS DOUBLE) AS x FROM base UNION ALL SELECT date, code, 'volume', CAST(volume AS DOUBLE) FROM base UNION ALL SELECT date, code, 'disc', disc FROM base)")
def ic_composite(p: Panels) -> DataFrame:
    """C5."""
    return composites.ic_composite(base(p), FACTORS, 12, 6).select("date", "code", tidy("target").alias("target"))


def weighted_z(source: str, target: str, columns: list[str], keep: str) -> str:
    """CTE with cap-weighted z-scores of columns by date."""
    ready = ", ".join(f"CASE WHEN {c} IS NOT NULL AND cap > 0 THEN cap END AS u_{c}" for c in columns)
    sums = ", ".join(f"sum(u_{c} * {c}) OVER d / sum(u_{c}) OVER d AS m_{c}, sum(u_{c} * {c} * {c}) OVER d / sum(u_{c}) OVER d AS q_{c}" for c in columns)
    z = ", ".join(f"CASE WHEN u_{c} IS NOT NULL THEN ({c} - m_{c}) / nullif(sqrt(greatest(q_{c} - m_{c} * m_{c}, 0)), 0) END AS {c}" for c in columns)
    return f"{target} AS (SELECT {keep}, {z} FROM (SELECT *, {sums} FROM (SELECT *, {ready} FROM {source}) AS x WINDOW d AS (PARTITION BY date)) AS y)"


def long_of(source: str, columns: list[str], target: str = "long", more: str = "") -> str:
    return f"{target} AS (" + " UNION ALL ".join(f"SELECT date, '{c}' AS factor, {c} AS x, ret{more} FROM {source}" for c in columns) + ")"


_BASED = "based AS (SELECT date, code, ret, CAST(cap AS DOUBLE) AS cap, CAST(cap AS DOUBLE) AS capital, CAST(price AS DOUBLE) AS price, CAST(volume AS DOUBLE) AS volume, disc FROM base)"


@query(
    f"SELECT date, code, {r('target', 'target')} FROM fz",
    RET, _BASED, weighted_z("based", "zx", ["price", "disc"], "date, code, ret, cap"), long_of("zx", ["price", "disc"]), IC, _W,
    long_of("zx", ["price", "disc"], "longer", ", code"),
    "comp AS (SELECT l.date, l.code, sum(CASE WHEN x IS NOT NULL THEN w * x END) / nullif(sum(CASE WHEN x IS NOT NULL THEN abs(w) END), 0) AS target FROM longer AS l LEFT JOIN wt ON wt.date = l.date AND wt.factor = l.factor GROUP BY 1, 2)",
    "capped AS (SELECT comp.*, CAST(cap AS DOUBLE) AS cap FROM comp LEFT JOIN panel ON panel.date = comp.date AND panel.code = comp.code)",
    weighted_z("capped", "fz", ["target"], "date, code"),
)
def composer_run(p: Panels) -> DataFrame:
    """The composer end to end, weighted z-scores before and after."""
    weight = p.panel.select("date", "code", F.col("cap").alias("weight"))
    c = Plain(store(p, "panel"), ["panel/price", "panel/disc"], "panel/price", window=12, weight=weight, least=6)
    return c.run().select("date", "code", tidy("target").alias("target"))


STYLES = {"size": ["cap", "volume"], "value": ["price", "disc"]}


@query(
    f"SELECT date, code, {r('size', 'size')}, {r('value', 'value')} FROM fz",
    RET, _BASED, weighted_z("based", "zx", ["capital", "volume", "price", "disc"], "date, code, ret, cap"), long_of("zx", ["capital", "volume", "price", "disc"]), IC, _W,
    long_of("zx", ["capital", "volume", "price", "disc"], "longer", ", code"),
    """comp AS (
  SELECT l.date, l.code, CASE WHEN l.factor IN ('capital', 'volume') THEN 'size' ELSE 'value' END AS style,
         sum(CASE WHEN x IS NOT NULL THEN w * x END) / nullif(sum(CASE WHEN x IS NOT NULL THEN abs(w) END), 0) AS v
  FROM longer AS l LEFT JOIN wt ON wt.date = l.date AND wt.factor = l.factor GROUP BY 1, 2, 3)""",
    """wide AS (
  SELECT b.date, b.code, b.cap, max(v) FILTER (WHERE style = 'size') AS size, max(v) FILTER (WHERE style = 'value') AS value
  FROM comp JOIN based AS b ON b.date = comp.date AND b.code = comp.code GROUP BY 1, 2, 3)""",
    weighted_z("wide", "fz", ["size", "value"], "date, code"),
)
def style_exposures(p: Panels) -> DataFrame:
    """C6."""
    out = composites.style_exposures(base(p), STYLES, "cap", 12, 6)
    return out.select("date", "code", tidy("size").alias("size"), tidy("value").alias("value"))


_IND = "bi AS (SELECT b.*, i.first_industry_code AS ind FROM base AS b JOIN industry AS i ON i.date = b.date AND i.code = b.code WHERE i.first_industry_code IS NOT NULL)"


def model_rows(p: Panels) -> DataFrame:
    """Rows of the model, written once: every regression reads them several times."""
    p = p.stored()
    return kept(base(p).join(p.industry, ["date", "code"]))


@query("SELECT date, ind AS industry FROM (SELECT date, ind, row_number() OVER (PARTITION BY date ORDER BY sum(cap) DESC, ind) AS k FROM bi GROUP BY 1, 2) AS x WHERE k = 1", RET, _IND)
def base_industry(p: Panels) -> DataFrame:
    """A22, L5."""
    return composites.base_industry(model_rows(p))


@query(f"SELECT date, {r('avg(CASE WHEN code % 3 = 0 THEN 0.0 ELSE 1.0 END)', 'v')} FROM panel GROUP BY 1")
def style_coverage(p: Panels) -> DataFrame:
    """A23."""
    rows = p.panel.withColumn("v", F.when(F.col("code") % 3 != 0, F.col("disc")))
    return composites.style_coverage(rows, ["v"]).select("date", tidy("v").alias("v"))


@query(
    f"""
SELECT date, 'const' AS term, {r('sum(w * m) / sum(w)', 'ret')} FROM im WHERE k > 1 GROUP BY 1
UNION ALL SELECT date, 'ind_' || ind, {r('m - sum(w * m) OVER (PARTITION BY date) / sum(w) OVER (PARTITION BY date)')} FROM im WHERE k > 1""",
    RET, _IND,
    """ir AS (SELECT date, ind, count(*) AS n, sum(cap) AS w, sum(cap * ret) / sum(cap) AS m FROM bi WHERE ret IS NOT NULL AND cap > 0 GROUP BY 1, 2),
im AS (SELECT *, count(*) OVER (PARTITION BY date) AS k FROM ir QUALIFY sum(n) OVER (PARTITION BY date) >= 20)""",
)
def barra_wls(p: Panels) -> DataFrame:
    """C7, industries only: cap-weighted industry means, levelled."""
    found, _ = composites.barra_regression(model_rows(p), [], min_codes=20)
    return found.select("date", "term", tidy("ret").alias("ret"))


_MODEL = (
    "bu AS (SELECT date, code, ind, ret AS y, CAST(cap AS DOUBLE) AS w, ln(volume) AS x1, disc AS x2, count(*) OVER (PARTITION BY date) AS codes FROM bi)",
    """bm AS (
  SELECT *, sum(w * x1) OVER k / sum(w) OVER k AS m1, sum(w * x2) OVER k / sum(w) OVER k AS m2, sum(w * y) OVER k / sum(w) OVER k AS my, count(*) OVER (PARTITION BY date) AS n
  FROM bu WHERE y IS NOT NULL AND w > 0 AND x1 IS NOT NULL AND x2 IS NOT NULL AND codes >= 20 WINDOW k AS (PARTITION BY date, ind)),
bs AS (
  SELECT date, sum(w * (x1 - m1) * (x1 - m1)) AS s11, sum(w * (x1 - m1) * (x2 - m2)) AS s12, sum(w * (x2 - m2) * (x2 - m2)) AS s22,
         sum(w * (x1 - m1) * (y - my)) AS t1, sum(w * (x2 - m2) * (y - my)) AS t2, count(DISTINCT ind) AS k, max(n) AS n
  FROM bm GROUP BY 1),
bb AS (SELECT date, (t1 * s22 - t2 * s12) / (s11 * s22 - s12 * s12) AS b1, (t2 * s11 - t1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM bs WHERE n >= greatest(20, k + 7)),
ba AS (SELECT bm.date, bm.ind, any_value(my - b1 * m1 - b2 * m2) AS a, sum(w) AS w FROM bm JOIN bb ON bb.date = bm.date GROUP BY 1, 2),
bc AS (SELECT date, sum(w * a) / sum(w) AS c, count(*) AS k FROM ba GROUP BY 1)""",
)
_RETURNS = f"""
SELECT date, 'const' AS term, {r('c', 'ret')} FROM bc
UNION ALL SELECT ba.date, 'ind_' || ind, {r('a - c')} FROM ba JOIN bc ON bc.date = ba.date WHERE k > 1
UNION ALL SELECT date, 'lv', {r('b1')} FROM bb UNION ALL SELECT date, 'disc', {r('b2')} FROM bb"""


def styled_rows(p: Panels) -> DataFrame:
    return model_rows(p).withColumn("lv", F.log("volume"))


@query(_RETURNS, RET, _IND, *_MODEL)
def barra_full(p: Panels) -> DataFrame:
    """C7 with styles: slopes inside industries, industry means of what they leave, levelled."""
    found, _ = composites.barra_regression(styled_rows(p), ["lv", "disc"], min_codes=20)
    return found.select("date", "term", tidy("ret").alias("ret"))


def model_store(p: Panels) -> FactorStore:
    s = FactorStore(p.spark, scratch_path(p.spark))
    composites.run_model(s, styled_rows(p), ["lv", "disc"], min_codes=20)
    return s


@query(_RETURNS, RET, _IND, *_MODEL)
def barra_saved(p: Panels) -> DataFrame:
    """Factor returns, saved and read again."""
    return model_store(p).table("factor_returns").select("date", "term", tidy("ret").alias("ret"))


@query(f"SELECT bm.date, code, {r('y - a - b1 * x1 - b2 * x2', 'specific')} FROM bm JOIN bb ON bb.date = bm.date JOIN ba ON ba.date = bm.date AND ba.ind = bm.ind", RET, _IND, *_MODEL)
def barra_specific(p: Panels) -> DataFrame:
    """Specific returns, saved and read again."""
    return model_store(p).table("specific_returns").select("date", "code", tidy("specific").alias("specific"))


@query(
    f"""
SELECT c.factor, {r('cv', 'coverage')}, nw.n, {r('nn.mean', 'mean')}, {r('nw_t', 'nw_t')}, {r('acf1', 'acf1')}
FROM (SELECT factor, avg(v) AS cv FROM (SELECT date, factor, count(x) / nullif(count(ret), 0) AS v FROM long GROUP BY 1, 2) AS y GROUP BY 1) AS c
JOIN nw ON nw.factor = c.factor JOIN nn ON nn.factor = c.factor JOIN (SELECT factor, corr(ic, b) AS acf1 FROM (SELECT factor, ic, lag(ic) OVER (PARTITION BY factor ORDER BY date) AS b FROM good) AS x GROUP BY 1) AS a ON a.factor = c.factor""",
    RET, LONG, IC, NW,
)
def summary_table(p: Panels) -> DataFrame:
    """One row per factor."""
    rows = evaluate.evaluation_panel(p.panel.select("date", "code", *FACTORS), base(p))
    out = evaluate.Evaluation(rows, FACTORS, groups=5, roll=12).run().summary()
    return out.select("factor", tidy("coverage").alias("coverage"), "n", tidy("mean").alias("mean"), tidy("nw_t").alias("nw_t"), tidy("acf1").alias("acf1"))


_EVAL = (
    _FEASIBLE,
    """fu AS (
  SELECT date, code, feasible, lead(p, 2) OVER c / nullif(lead(p, 1) OVER c, 0) - 1 AS r1, lead(p, 3) OVER c / nullif(lead(p, 1) OVER c, 0) - 1 AS r2, dense_rank() OVER (ORDER BY date) AS k
  FROM (SELECT q.date, q.code, CASE WHEN feasible THEN q.price END AS p, coalesce(feasible, true) AS feasible FROM quotes AS q LEFT JOIN feas ON feas.date = q.date AND feas.code = q.code) AS x
  WINDOW c AS (PARTITION BY code ORDER BY date))""",
    """ev AS (
  SELECT 'h1' AS test_key, p.date, p.code, r1 AS ret, feasible, disc, CAST(cap AS DOUBLE) AS cap FROM panel AS p JOIN fu ON fu.date = p.date AND fu.code = p.code
  UNION ALL SELECT 'h2', p.date, p.code, r2, feasible, disc, cap FROM panel AS p JOIN fu ON fu.date = p.date AND fu.code = p.code WHERE (k - 1) % 2 = 0)""",
    """lf AS (
  SELECT test_key, date, code, ret, feasible, 'disc' AS factor, disc AS x FROM ev
  UNION ALL SELECT test_key, date, code, ret, feasible, 'cap', cap FROM ev WHERE test_key = 'h1'
  UNION ALL SELECT test_key, date, code, ret, feasible, 'disc_ortho', CASE WHEN n > 2 THEN disc - my - b * (cap - mx) END
  FROM (SELECT *, regr_slope(disc, cap) OVER d AS b, avg(cap) OVER d AS mx, avg(disc) OVER d AS my, count(*) OVER d AS n FROM ev WHERE test_key = 'h1' WINDOW d AS (PARTITION BY date)) AS x)""",
    "ec AS (SELECT test_key, factor, avg(v) AS coverage FROM (SELECT test_key, factor, date, count(x) / nullif(count(ret), 0) AS v FROM lf GROUP BY 1, 2, 3) AS x GROUP BY 1, 2)",
    """er AS (
  SELECT test_key, factor, date, rank() OVER (d ORDER BY x) + (count(*) OVER (PARTITION BY test_key, factor, date, x) - 1) / 2.0 AS rx,
         rank() OVER (d ORDER BY ret) + (count(*) OVER (PARTITION BY test_key, factor, date, ret) - 1) / 2.0 AS ry
  FROM lf WHERE x IS NOT NULL AND ret IS NOT NULL WINDOW d AS (PARTITION BY test_key, factor, date)),
ei AS (SELECT test_key, factor, count(*) AS n, avg(c) AS mean FROM (SELECT test_key, factor, date, corr(rx, ry) AS c, count(*) AS m FROM er GROUP BY 1, 2, 3) AS x WHERE m >= 2 AND NOT isnan(c) GROUP BY 1, 2)""",
    "eg AS (SELECT * FROM lf WHERE ret IS NOT NULL AND feasible)",
    bucket("eg", "eb", "x", "test_key, factor, date", 5, "grp"),
    """es AS (
  SELECT test_key, factor, avg(slope) AS slope_mean
  FROM (SELECT test_key, factor, date, regr_slope(ret, grp) AS slope
        FROM (SELECT test_key, factor, date, grp, avg(ret) AS ret FROM eb WHERE grp IS NOT NULL GROUP BY 1, 2, 3, 4) AS x GROUP BY 1, 2, 3 HAVING count(*) >= 5) AS y GROUP BY 1, 2)""",
)


def evaluations(p: Panels) -> dict[str, evaluate.Evaluation]:
    p = p.stored("quotes")
    return {
        "h1": evaluate.run_test(p.quotes, p.instruments, p.panel.select("date", "code", "disc", "cap"), ["disc", "cap"], groups=5, roll=12, baseline=["cap"]),
        "h2": evaluate.run_test(p.quotes, p.instruments, p.panel.select("date", "code", "disc"), ["disc"], horizon=2, groups=5, roll=12),
    }


_TESTS = f"""
SELECT ec.test_key, ec.factor, CASE WHEN ec.factor = 'disc_ortho' THEN 'inc' ELSE 'raw' END AS restype, n, {r('coverage', 'coverage')}, {r('mean', 'mean')}, {r('slope_mean', 'slope_mean')}
FROM ec LEFT JOIN ei ON ei.test_key = ec.test_key AND ei.factor = ec.factor LEFT JOIN es ON es.test_key = ec.test_key AND es.factor = ec.factor"""


@query(_TESTS, *_EVAL)
def evaluation_run(p: Panels) -> DataFrame:
    """Two tests end to end with feasibility, rebalancing and a baseline."""
    out = evaluate.run_tests(evaluations(p))
    return out.select("test_key", "factor", "restype", "n", tidy("coverage").alias("coverage"), tidy("mean").alias("mean"), tidy("slope_mean").alias("slope_mean"))


_BETWEEN = (
    f"SELECT date, f1, f2, {r('CASE WHEN NOT isnan(c) THEN c END', 'corr')} FROM (" + " UNION ALL ".join(f"SELECT date, '{a}' AS f1, '{b}' AS f2, corr({a}, {b}) AS c FROM wide GROUP BY 1" for i, a in enumerate(["h1__cap", "h1__disc", "h1__disc_ortho", "h2__disc"]) for b in ["h1__cap", "h1__disc", "h1__disc_ortho", "h2__disc"][i + 1 :]) + ") AS x",
    *_EVAL[:4],
    """wide AS (
  SELECT date, code, max(x) FILTER (WHERE test_key = 'h1' AND factor = 'cap') AS h1__cap, max(x) FILTER (WHERE test_key = 'h1' AND factor = 'disc') AS h1__disc,
         max(x) FILTER (WHERE factor = 'disc_ortho') AS h1__disc_ortho, max(x) FILTER (WHERE test_key = 'h2') AS h2__disc
  FROM lf GROUP BY 1, 2)""",
)


@query(*_BETWEEN)
def evaluation_correlation(p: Panels) -> DataFrame:
    """Correlations over the outer-joined factors of two tests."""
    return evaluate.total_correlation(evaluations(p)).select("date", "f1", "f2", tidy("corr").alias("corr"))


def together(p: Panels) -> Together:
    p = p.stored("quotes")
    tests = {"h1": Test(("disc", "cap"), baseline=("cap",)), "h2": Test(("disc",), horizon=2)}
    return run_together(p.quotes, p.instruments, p.panel.select("date", "code", "disc", "cap"), tests, groups=5, roll=12)


@query(_TESTS, *_EVAL)
def evaluation_together(p: Panels) -> DataFrame:
    """The tests of ``evaluation_run`` as rows of one plan."""
    out = together(p).summary()
    return out.select("test_key", "factor", "restype", "n", tidy("coverage").alias("coverage"), tidy("mean").alias("mean"), tidy("slope_mean").alias("slope_mean"))


@query(*_BETWEEN)
def evaluation_together_correlation(p: Panels) -> DataFrame:
    """Correlations over the factors of all tests of one plan."""
    return together(p).correlation().select("date", "f1", "f2", tidy("corr").alias("corr"))


_LOADED = "rows_ AS (SELECT p.date, p.code, p.disc, p.cap AS weight, r1 AS ret FROM panel AS p JOIN fu ON fu.date = p.date AND fu.code = p.code WHERE feasible AND r1 IS NOT NULL AND p.date BETWEEN DATE '1994-01-01' AND DATE '1996-12-01')"


@query(
    f"SELECT date, 'disc' AS factor, grp, {r('CASE WHEN sum(greatest(weight, 0)) > 0 THEN sum(greatest(weight, 0) * ret) / sum(greatest(weight, 0)) ELSE avg(ret) END', 'ret')} FROM gb WHERE grp IS NOT NULL GROUP BY date, grp",
    *_EVAL[:2], _LOADED, bucket("rows_", "gb", "disc", "date", 5, "grp"),
)
def evaluation_loaded(p: Panels) -> DataFrame:
    """One test from a store's paths, with weights and a range of dates; the returns of its groups."""
    test = evaluate.load_test(store(p.stored("quotes"), "panel", "quotes", "instruments"), ["panel/disc"], "quotes/price", "panel/cap", _D(1994, 1, 1), _D(1996, 12, 1), groups=5, roll=12)
    return test.tables["groups"].select("date", "factor", "grp", tidy("ret").alias("ret"))


@query(
    f"""
SELECT grp, CAST(least(floor((ret - lo) / (hi - lo) * 10) + 1, 10) AS INTEGER) AS bin, count(*) AS n
FROM (SELECT *, min(ret) OVER (PARTITION BY grp) AS lo, max(ret) OVER (PARTITION BY grp) AS hi FROM groups_) AS x GROUP BY 1, 2""",
    RET, _ROWS, _G, _SINGLE,
)
def report_series(p: Panels) -> DataFrame:
    """Distribution of group returns."""
    return evaluate.return_distribution(single(p), 10)


def refreshed(p: Panels, panel: DataFrame, processors: list | None = None) -> DataFrame:
    """The table of a store after ``panel`` with zeros and then ``panel`` itself came by stream, each as a batch of its own."""
    spark, source, root, checkpoint = p.spark, scratch_path(p.spark), scratch_path(p.spark), scratch_path(p.spark)
    rows = panel.select("date", "code", "price", F.col("volume").cast("double").alias("volume"), F.lit(2).alias("version"))
    old = rows.select("date", "code", F.lit(0.0).alias("price"), F.lit(0.0).alias("volume"), F.lit(1).alias("version"))
    s = FactorStore(spark, root)
    for version in (old, rows):
        version.write.mode("append").parquet(source)
        # the checkpoint remembers the files of the first batch
        stream = spark.readStream.schema(rows.schema).parquet(source)
        upsert_stream(stream, s, "factor", checkpoint, order="version", processors=processors).awaitTermination()
    return s.table("factor")


@query("SELECT date, code, price, volume FROM panel")
def stream_refresh(p: Panels) -> DataFrame:
    """S9, S6 by stream: files arrive twice, the later rows replace the stored ones."""
    return refreshed(p, p.panel).select("date", "code", "price", "volume")


@query(f"SELECT date, code, price, {r('(price - avg(price) OVER d) / nullif(stddev_samp(price) OVER d, 0)', 'z')} FROM panel WINDOW d AS (PARTITION BY date)")
def stream_refresh_whole(p: Panels) -> DataFrame:
    """S9, S6, X16 by stream: every batch with a processed copy of its columns."""
    rows = refreshed(p, p.panel, [transforms.processor(transforms.zscore)])
    return rows.select("date", "code", "price", tidy("price__zscore").alias("z"))
