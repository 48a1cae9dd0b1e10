"""URL filter: path rules, and for the rest the ratio of two character language models; DataFrame functions only.

Models: URLs that a rule allows (accepted) and that a rule blocks (rejected). For each class, a smoothed variable-order
Markov model over the characters of host || path, orders 0..ORDER, by Witten-Bell interpolation from the shortest to the
longest context: p_k(c | ctx) = (n(ctx c) + t(ctx) * p_{k-1}(c | shorter ctx)) / (n(ctx) + t(ctx)), with t the distinct
successors of ctx in that class. All counts are over every page; hot contexts meet map-side before they are shuffled.
Each gram's log-ratio is worked out once and joined to the characters of the distinct host-and-path strings, so a string
that many pages share is scored once. The COMMON commonest grams are broadcast; any other is at most one of COMMON + 1 characters,
so the shuffled join of the rest has no hot key.

score = (log p_accepted - log p_rejected) / (characters + 1). Calibration: labelled strings that the counts leave out (those
whose MD5 begins with 0, 1 or 2), weighted so that both classes count alike, in
CELLS bins of the score; the threshold is the middle between two bins that has the fewest weighted errors (ties: nearest to
0). Below it the verdict is block. `held_out_error` is the mean of both classes' shares on the wrong side of it, among the held-out strings' pages (which
also choose it); null where these lack a class: then the threshold is 0, where both models are as likely.

Cases: null url or no `://`: host and path empty, score 0. No labelled URL of one class: the ratio is 0 everywhere and
the threshold 0, so unruled URLs are allowed. Very long URLs are taken whole. A rule's host fits itself and its subdomains; longest rule (host, then
path) wins. Extra columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, table

#: (host, path, verdict). Fixed values of the contract.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
ORDER = 4
#: Size of the alphabet that order 0 falls back to.
ALPHABET = 256
CELLS, WIDTH = 2001, 0.01
#: Grams whose ratios are broadcast, ORDER + 1 characters each.
COMMON = 4096
START, END = "\u0002", "\u0003"


def host_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    cut = F.instr(u, "://")
    rest = F.when(cut > 0, F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, rule_verdict. pages: page_id and url."""
    host, path = host_path(F.col("url"))
    out = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0])):  # the longest last, so it wins
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _grams(strings: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each character of START * ORDER || s || END with its longest gram: ORDER characters of context and itself."""
    padded = F.concat(F.lit(START * ORDER), F.col("s"), F.lit(END))
    every = F.transform(F.sequence(F.lit(1), F.length("s") + 1), lambda i: F.substring(F.col("padded"), i, F.lit(ORDER + 1)))
    return strings.withColumn("padded", padded).select(*keep, F.explode(every).alias("gram"))


def model(strings: DataFrame) -> DataFrame:
    """(gram, ratio, n): log p_accepted - log p_rejected of the last character after the others, for every gram of the strings, and how often it comes.

    strings: s, accepted, rejected (pages with that string in either class; 0 where it has no label).
    """
    counts = _grams(strings, ["accepted", "rejected"]).groupBy("gram").agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"), F.count(F.lit(1)).alias("n"))
    out = materialize(counts)
    probabilities = None
    for k in range(ORDER + 1):
        here = out.select(F.substring("gram", ORDER + 1 - k, k + 1).alias("g"), "a", "r", "n").groupBy("g").agg(F.sum("a").alias("a"), F.sum("r").alias("r"), F.sum("n").alias("n"))
        here = here.withColumn("ctx", F.substring("g", 1, k))
        ctx = here.groupBy("ctx").agg(
            F.sum("a").alias("na"), F.sum("r").alias("nr"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("r") > 0).alias("tr")
        )
        here = here.join(ctx, "ctx")
        if probabilities is None:
            here = here.withColumn("qa", F.lit(1.0 / ALPHABET)).withColumn("qr", F.lit(1.0 / ALPHABET))
        else:
            here = here.withColumn("shorter", F.substring("g", 2, k)).join(probabilities, "shorter")
        p = lambda n, total, kinds, q: F.when(F.col(total) > 0, (F.col(n) + F.col(kinds) * F.col(q)) / (F.col(total) + F.col(kinds))).otherwise(F.col(q))
        times = ["n"] if k == ORDER else []
        probabilities = here.select(F.col("g").alias("shorter"), p("a", "na", "ta", "qa").alias("qa"), p("r", "nr", "tr", "qr").alias("qr"), *times)
    return materialize(probabilities.select(F.col("shorter").alias("gram"), (F.log("qa") - F.log("qr")).alias("ratio"), "n"))


def score_strings(strings: DataFrame) -> DataFrame:
    """s, accepted, rejected, held, score for each distinct string; held ones are labelled but not counted."""
    strings = strings.withColumn("held", (F.col("accepted") + F.col("rejected") > 0) & F.md5(F.col("s").cast("binary")).rlike("^[012]"))
    counted = lambda c: F.when(F.col("held"), 0).otherwise(F.col(c)).cast("long").alias(c)
    ratios = model(strings.select("s", counted("accepted"), counted("rejected")))
    common = F.broadcast(materialize(ratios.orderBy(F.desc("n"), "gram").limit(COMMON).select("gram", "ratio")))
    grams = _grams(strings, ["s"])
    rest = grams.join(common, "gram", "left_anti").join(ratios.select("gram", "ratio"), "gram")
    scored = grams.join(common, "gram").unionByName(rest).groupBy("s").agg((F.sum("ratio") / F.count(F.lit(1))).alias("score"))
    return strings.join(scored, "s", "left").select("s", "accepted", "rejected", "held", F.when(F.col("s") == "", 0.0).otherwise(F.col("score")).alias("score"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row (threshold, errors): between two score bins, where the fewest errors are, both classes weighing alike; null without both."""
    half = CELLS // 2
    cell = F.greatest(F.lit(-half), F.least(F.lit(half), F.floor(F.col("score") / WIDTH).cast("int")))
    bins = scored.where("accepted + rejected > 0").groupBy(cell.alias("cell")).agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"))
    by_cell, all_rows = Window.orderBy("cell"), Window.partitionBy()  # at most CELLS rows
    up_to = by_cell.rowsBetween(Window.unboundedPreceding, -1)
    both = (F.sum("a").over(all_rows) > 0) & (F.sum("r").over(all_rows) > 0)
    share = lambda c: F.try_divide(F.coalesce(F.sum(c).over(up_to), F.lit(0)), F.sum(c).over(all_rows))
    middle = F.coalesce((F.lag("cell").over(by_cell) + 1 + F.col("cell")) / F.lit(2.0), F.col("cell").cast("double"))
    edges = bins.select(middle.alias("edge"), F.when(both, share("a") + 1 - share("r")).alias("errors"))
    best = edges.where("errors is not null").agg(F.min(F.struct("errors", F.abs("edge").alias("far"), "edge")).alias("best"))
    return best.select((F.col("best.edge") * F.lit(WIDTH)).alias("threshold"), F.col("best.errors").alias("errors"))


def url_filter(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score, threshold, held_out_error for each page."""
    judged = ruled(pages, rules)
    s = F.concat("host", "path")
    strings = materialize(
        judged.groupBy(s.alias("s")).agg(F.count_if(F.col("rule_verdict") == "allow").alias("accepted"), F.count_if(F.col("rule_verdict") == "block").alias("rejected"))
    )
    scored = materialize(score_strings(strings))
    limit, errors = threshold(scored.where("held")).first()
    limit = 0.0 if limit is None else limit
    return (
        judged.withColumn("s", s)
        .join(scored.select("s", "score"), "s")
        .select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(F.col("score") < limit, "block").otherwise("allow")).alias("verdict"), "score", F.lit(limit).alias("threshold"), (F.lit(errors).cast("double") / 2).alias("held_out_error"))
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    """Rules, both models, calibration and verdicts in DuckDB's SQL."""
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    longest = sorted(RULES, key=lambda r: (len(r[0] + r[1]), r[0]), reverse=True)
    rule, verdict = (" ".join(f"WHEN {fits(h, p)} THEN '{x}'" for h, p, v in longest for x in [(h + p, v)[k]]) for k in (0, 1))
    rest = "CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substring(url, position('://' IN url) + 3) ELSE '' END"
    orders = []
    for k in range(ORDER + 1):
        q = f"h.a AS a, h.r AS r, na, nr, ta, tr, {1 / ALPHABET} AS qa, {1 / ALPHABET} AS qr FROM h{k} h" if not k else f"h.a, h.r, na, nr, ta, tr, qa, qr FROM h{k} h JOIN p{k - 1} q ON q.g = substring(h.g, 2, {k})"
        orders.append(f"""h{k} AS (SELECT substring(gram, {ORDER + 1 - k}, {k + 1}) AS g, sum(a) AS a, sum(r) AS r FROM n GROUP BY 1),
    c{k} AS (SELECT substring(g, 1, {k}) AS ctx, sum(a) AS na, sum(r) AS nr, count(*) FILTER (WHERE a > 0) AS ta, count(*) FILTER (WHERE r > 0) AS tr FROM h{k} GROUP BY 1),
    p{k} AS (SELECT g, CASE WHEN na > 0 THEN (a + ta * qa) / (na + ta) ELSE qa END AS qa, CASE WHEN nr > 0 THEN (r + tr * qr) / (nr + tr) ELSE qr END AS qr
             FROM (SELECT h.g, {q} JOIN c{k} c ON c.ctx = substring(h.g, 1, {k})))""")
    half = CELLS // 2
    edges = lambda name, where: f"""b{name} AS (SELECT greatest(-{half}, least({half}, floor(score / {WIDTH})::INTEGER)) AS cell, sum(accepted) AS a, sum(rejected) AS r FROM scored WHERE accepted + rejected > 0 AND {where} GROUP BY 1),
    e{name} AS (SELECT coalesce((lag(cell) OVER (ORDER BY cell) + 1 + cell) / 2.0::DOUBLE, cell::DOUBLE) AS edge,
                CASE WHEN sum(a) OVER () > 0 AND sum(r) OVER () > 0 THEN coalesce(sum(a) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(a) OVER () + 1 - coalesce(sum(r) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(r) OVER () END AS errors FROM b{name}),
    t{name} AS (SELECT (SELECT edge * {WIDTH} FROM e{name} WHERE errors IS NOT NULL ORDER BY errors, abs(edge), edge LIMIT 1) AS threshold)"""  # noqa: E731
    return f"""
    WITH u AS (SELECT page_id, {rest} AS rest FROM pages),
    d AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
    j AS (SELECT *, host || path AS s, CASE {rule} END AS rule, CASE {verdict} END AS ruled FROM d),
    s AS (SELECT s, count(*) FILTER (WHERE ruled = 'allow') AS accepted, count(*) FILTER (WHERE ruled = 'block') AS rejected FROM j GROUP BY s),
    l AS (SELECT *, accepted + rejected > 0 AND md5(s)[1] IN ('0', '1', '2') AS held, repeat(chr(2), {ORDER}) || s || chr(3) AS padded FROM s),
    x AS (SELECT s, CASE WHEN held THEN 0 ELSE accepted END AS a, CASE WHEN held THEN 0 ELSE rejected END AS r, substring(padded, i, {ORDER + 1}) AS gram FROM (SELECT *, unnest(range(1, length(s) + 2)) AS i FROM l)),
    n AS (SELECT gram, sum(a) AS a, sum(r) AS r FROM x GROUP BY gram),
    {", ".join(orders)},
    z AS (SELECT s, sum(ln(qa) - ln(qr)) / count(*) AS score FROM x JOIN p{ORDER} p ON p.g = x.gram GROUP BY s),
    scored AS (SELECT l.s, accepted, rejected, held, CASE WHEN l.s = '' THEN 0.0 ELSE score END AS score FROM l JOIN z ON z.s = l.s),
    {edges("h", "held")}
    SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score < (SELECT coalesce(th.threshold, 0.0) FROM th) THEN 'block' ELSE 'allow' END) AS verdict
    FROM j JOIN scored ON scored.s = j.s
    """
