"""Mixing sources to target weights: iterative proportional fitting under probabilities, then sampling by them.

Documents are summed to cells (source, language, topic) of token weight; everything after that works on cells.  Each
document of a cell is kept with the cell's probability, min(1, x(source) * v(language) * u(topic)).  Raking finds the
three factors so that the expected kept tokens of every source, language and topic are its target share of the budget:
a source's factor is solved exactly, cells at probability 1 held fixed, then those of languages and topics take one step
each.  So probabilities never have to be clipped afterwards, and the shares hold for what is kept.

The budget is cut to what targets and tokens allow: first to the least of tokens over target share among the listed
classes, then to CUT of it as often as raking is off by more than TOLERANCE and TRIAL more rounds bring it no nearer.  Sources that aren't
listed share by tempered weight, none more than halfway between the average probability and all of its tokens.
achieved() gives the targets and the shares that the probabilities reach, and the budget.  A document is kept if a hash
of its id falls under its probability: the choice is the same in every run and for every copy of a row.

Only DataFrame functions: one shuffle makes the table of sources, whose rows hold their cells as an array, and each round
is one aggregation over it.  The source step is inside each row.  Languages and topics are listed in the parameters,
with the rest of each together in one class, so what a round brings to the driver has a fixed size.

Tokens are counted as a tokenizer's first cut makes them: runs of letters, digits and _, and single other marks.
Topics, unless given as an expression: the first of the fixed rules below that a text meets.

Defined cases: null language or source is the class ''; null or empty text weighs one token; a null id hashes as the
empty text; cells of a class whose target is 0 have probability 0; a class with target but without documents leaves its
share to the others; repeated rows weigh and fare alike; an empty table gives an empty result; if no budget meets the
targets (classes that exclude one another), the last one's probabilities stand and achieved() shows how far off they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Raking ends when no share is off by EXACT; a budget is given up if one is off by TOLERANCE and TRIAL rounds leave NEARER of that.
ROUNDS, TRIAL, NEARER = 100, 5, 0.6
EXACT, TOLERANCE = 1e-9, 1e-3
CUT, CUTS = 0.8, 20
OTHER = "*"
#: Topic rules: the first of which a text holds any part; fixed values of this operator.
TOPICS = (
    ("license", ("icense", "ICENSE", "opyright", "COPYRIGHT", "©")),
    ("secrets", ("token =", "TOKEN =", "password", "secret_")),
    ("tables", (" | ",)),
    ("symbols", ("###", "%%%", "$$$", "&&&", "***", "!!")),
    ("prose", (". ", ".\n")),
)


@dataclass(frozen=True)
class Targets:
    """Target shares by class; OTHER stands for all classes that aren't listed. Sources not listed share by tempering."""

    languages: dict[str, float]
    topics: dict[str, float]
    sources: dict[str, float] = field(default_factory=dict)
    temper: float = 0.5  # an unlisted source's share goes with its weight to this power
    budget: float = 0.5  # expected share of all tokens that is kept
    least: float = 0.05  # what the budget may be cut to


def topic_of(text: Column) -> Column:
    rules = F.lit(OTHER)
    for name, parts in reversed(TOPICS):
        rules = F.when(reduce(Column.__or__, map(text.contains, parts)), name).otherwise(rules)
    return rules


def _listed(column: Column, names: dict[str, float]) -> Column:
    """The place of the column's class among the sorted names; OTHER comes last."""
    order = [n for n in sorted(names) if n != OTHER]
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)).cast("array<string>"), F.coalesce(column, F.lit(""))), F.lit(0)) - 1, F.lit(len(order))).cast("int")


def _shares(names: dict[str, float]) -> list[float]:
    return [names[n] for n in sorted(names) if n != OTHER] + [names.get(OTHER, 0.0)]


#: What counts as a token.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x09-\x0D\x20]"


def weighed(docs: DataFrame, targets: Targets, topic: Column | None = None) -> DataFrame:
    """docs (text, lang, source and others) with topic, tokens and the cell: own_source, k = l * topics + t."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("topic", topic_of(text) if topic is None else topic)
    cell = _listed(F.col("lang"), targets.languages) * len(_shares(targets.topics)) + _listed(F.col("topic"), targets.topics)
    tokens = F.greatest(F.regexp_count(text, F.lit(TOKEN)), F.lit(1))
    return out.withColumns({"tokens": tokens.cast("long"), "own_source": F.coalesce("source", F.lit("")), "k": cell})


@dataclass
class Fit:
    """Raked cells: sources (own_source, ws, x) with their cells' tokens and factor, the other factors, and how it went."""

    sources: DataFrame
    v: list[float]
    u: list[float]
    budget: float  # expected share of all tokens
    error: float  # the largest difference of a language's or topic's share from its target
    rounds: int


def _present(goals: list[float], weights: list[float]) -> list[float]:
    """Goals among the classes that have any weight, so that absent ones leave theirs to the others."""
    there = sum(g for g, w in zip(goals, weights, strict=True) if w > 0)
    return [g / there if w > 0 and there > 0 else 0.0 for g, w in zip(goals, weights, strict=True)]


def _filled(goals: list[float], caps: list[float]) -> list[float]:
    """Shares in proportion to goals, none above its cap."""
    full: set[int] = set()
    while True:
        left, open_ = 1 - sum(caps[i] for i in full), sum(g for i, g in enumerate(goals) if i not in full)
        out = [caps[i] if i in full else g * left / open_ for i, g in enumerate(goals)] if open_ else list(caps)
        more = {i for i, x in enumerate(out) if i not in full and x > caps[i] * (1 + 1e-12)}
        if not more:
            return out
        full |= more


def _source_factor(f: list[float]) -> str:
    """SQL for x with sum(w * min(1, x * f)) = goal, exactly: of the cells by ascending f, the longest run that stays under 1 shares what the others leave."""
    order = sorted((k for k in range(len(f)) if f[k] > 0), key=f.__getitem__)
    cells = ", ".join(f"named_struct('k', {k}, 'f', {f[k]!r}D)" for k in order)
    more = "named_struct('w', a.w + ws[c.k], 'open', a.open + ws[c.k] * c.f, 'x', a.x)"
    x = "(goal - (reach - a.w)) / a.open"
    step = f"transform(array({more}), a -> named_struct('w', a.w, 'open', a.open, 'x', if(a.open > 0 and {x} > 0 and {x} * c.f <= 1, {x}, a.x)))[0]"
    return f"if(goal > 0, aggregate(array({cells}), named_struct('w', 0D, 'open', 0D, 'x', {1 / f[order[0]]!r}D), (a, c) -> {step}).x, 0D)" if order else "0D"


def _goals(sources: DataFrame, targets: Targets, need: float) -> DataFrame:
    """sources (own_source, ws, reach) with goal, in tokens of `need` in all: listed shares, the rest by tempered and capped weight."""
    listed = {n: x for n, x in targets.sources.items() if n != OTHER}
    own = F.col("own_source").isin(*listed) if listed else F.lit(False)
    sized = sources.withColumn("own", own).withColumn("tempered", F.when(~F.col("own") & (F.col("reach") > 0), F.pow("reach", F.lit(targets.temper))).otherwise(0.0))
    sums = sized.agg(F.sum("reach").alias("reach"), F.sum("tempered").alias("open"), F.sum(F.when(~F.col("own"), F.col("reach"))).alias("rest")).first()
    have = {r.own_source: r.reach for r in sized.where("own").select("own_source", "reach").collect()} if listed else {}  # as many as are listed
    names = [n for n in listed if have.get(n)]
    goals = [listed[n] for n in names] + ([targets.sources.get(OTHER, max(0.0, 1 - sum(listed.values()))) if listed else 1.0] if sums["open"] else [])
    shares = _filled(_present(goals, goals), [have[n] / need for n in names] + ([sums["rest"] / need] if sums["open"] else []))
    rest = shares[len(names)] * need if sums["open"] else 0.0
    cap = F.col("reach") * (1 + rest / (sums["rest"] or 1.0)) / 2
    c, before = 0.0, -1.0
    while c != before and rest:
        full = F.col("tempered") * c > cap
        s = sized.where("not own").agg(F.sum(F.when(full, cap)).alias("full"), F.sum(F.when(~full, F.col("tempered"))).alias("open")).first()
        before, c = c, max(c, (rest - (s["full"] or 0.0)) / s["open"]) if s["open"] else c
    named = F.create_map(*(F.lit(x) for n, g in zip(names, shares, strict=False) for x in (n, g * need)))[F.col("own_source")] if names else F.lit(None).cast("double")
    return sized.withColumn("goal", F.coalesce(named, F.when(~F.col("own"), F.least(F.col("tempered") * c, cap)), F.lit(0.0))).drop("own", "tempered")


def rake(rows: DataFrame, targets: Targets) -> Fit:
    """Of rows (own_source, k, tokens)."""
    goal_l, goal_t = _shares(targets.languages), _shares(targets.topics)
    nl, nt = len(goal_l), len(goal_t)
    size = nl * nt
    sums = (F.sum(F.when(F.col("k") == k, F.col("tokens")).otherwise(0)).cast("double") for k in range(size))
    table = C.stored(rows.groupBy("own_source").agg(F.array(*sums).alias("ws")), "mixing-cells")
    got = table.select(F.posexplode("ws").alias("k", "w")).groupBy("k").agg(F.sum("w").alias("w")).collect()  # a row a cell
    all_of = {r.k: r.w for r in got}
    whole = sum(all_of.values())
    open_ = [goal_l[k // nt] > 0 and goal_t[k % nt] > 0 for k in range(size)]
    weight = [all_of.get(k, 0.0) * open_[k] for k in range(size)]
    by_l, by_t = [sum(weight[l * nt : (l + 1) * nt]) for l in range(nl)], [sum(weight[t::nt]) for t in range(nt)]  # noqa: E741
    goal_l, goal_t = _present(goal_l, by_l), _present(goal_t, by_t)
    reach = reduce(Column.__add__, (F.get("ws", F.lit(k)) for k in range(size) if open_[k])) if any(open_) else F.lit(0.0)
    sources = table.withColumn("reach", reach)
    listed = [n for n, x in targets.sources.items() if n != OTHER and x > 0]
    there = {r.own_source: r.reach for r in sources.where(F.col("own_source").isin(*listed) & (F.col("reach") > 0)).select("own_source", "reach").collect()} if listed and whole else {}
    room = [(w, g) for gs, ws in ((goal_l, by_l), (goal_t, by_t)) for g, w in zip(gs, ws, strict=True)] + [(w, targets.sources[n]) for n, w in there.items()]
    most = sum(weight) / whole if whole else 0.0
    least = min(targets.least, targets.budget, most)
    budget = max(least, min([targets.budget, most, *(w / whole / g for w, g in room if g > 0)])) if whole else 0.0
    if not budget:
        return Fit(sources.select("own_source", "ws", F.lit(0.0).alias("x")), [0.0] * nl, [0.0] * nt, 0.0, 0.0, 0)
    goal_l, goal_t = (_filled(g, [w / whole / budget for w in ws]) for g, ws in ((goal_l, by_l), (goal_t, by_t)))
    goals = C.stored(_goals(sources, targets, budget * whole), "mixing-goals", table)
    rounds = 0
    for cut in range(CUTS):
        share = max(budget * CUT**cut, least)
        sized = goals.withColumn("goal", F.col("goal") * (share / budget))
        v, u, error = [float(g > 0) for g in goal_l], [share * (g > 0) for g in goal_t], 1.0
        mark = 0.0
        for nth in range(1, ROUNDS + 1):
            f = [v[k // nt] * u[k % nt] for k in range(size)]
            x = sized.withColumn("x", F.expr(_source_factor(f)))
            # as text: building these expressions call by call takes longer than a round
            p = "transform(array(" + ", ".join(f"{y!r}D" for y in f) + "), y -> y * x)"
            each = F.expr(f"posexplode(zip_with(ws, {p}, (w, p) -> named_struct('sat', if(p >= 1, w, 0D), 'move', if(p < 1, w * p, 0D))))").alias("k", "c")
            sat, move = [0.0] * size, [0.0] * size
            for r in x.select(each).groupBy("k").agg(F.sum("c.sat").alias("sat"), F.sum("c.move").alias("move")).collect():
                sat[r.k], move[r.k] = r.sat, r.move
            rounds, need = rounds + 1, share * whole
            of_l = [(sum(sat[l * nt : (l + 1) * nt]), sum(move[l * nt : (l + 1) * nt])) for l in range(nl)]  # noqa: E741
            of_t = [(sum(sat[t::nt]), sum(move[t::nt])) for t in range(nt)]
            error = max(abs((a + b) / need - g) for gs, of in ((goal_l, of_l), (goal_t, of_t)) for g, (a, b) in zip(gs, of, strict=True))
            if error < EXACT or nth == ROUNDS or nth % TRIAL == 0 and error > max(TOLERANCE, NEARER * mark):
                break
            mark = error if nth == 1 or nth % TRIAL == 0 else mark
            by = [_step(g * need, a, b) for g, (a, b) in zip(goal_l, of_l, strict=True)]
            v = [y * b for y, b in zip(v, by, strict=True)]
            move = [m * by[k // nt] for k, m in enumerate(move)]
            u = [y * _step(g * need, a, sum(move[t::nt])) for t, (y, g, (a, _)) in enumerate(zip(u, goal_t, of_t, strict=True))]
        if error <= TOLERANCE or share == least:
            break
    return Fit(x.select("own_source", "ws", "x"), v, u, share, error, rounds)


def _step(goal: float, sat: float, move: float) -> float:
    """What brings sat, which stays, and move, which is multiplied, to the goal; both are, if sat alone is too much."""
    if goal > sat and move > 0:
        return (goal - sat) / move
    return goal / (sat + move) if sat + move > 0 else 1.0


def _chance(name: str = "doc_id") -> Column:
    """A number in [0, 1) from the id alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mixing "), F.coalesce(F.col(name).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _six(x: Column) -> Column:
    return F.floor(x * 1e6 + 0.5) / 1e6


def probabilities(fit: Fit) -> DataFrame:
    """(own_source, k, tokens, probability, factor) of the cells; factor: probability over the budget."""
    f = F.array(*(F.lit(a * b) for a in fit.v for b in fit.u))
    cells = fit.sources.select("own_source", "x", F.posexplode(F.arrays_zip(F.col("ws").alias("w"), f.alias("f"))).alias("k", "c")).where("c.w > 0")
    p = F.least(F.lit(1.0), F.col("x") * F.col("c.f"))
    return cells.select("own_source", "k", F.col("c.w").alias("tokens"), _six(p).alias("probability"), _six(p / (fit.budget or 1.0)).alias("factor"))


def achieved(fit: Fit, targets: Targets) -> DataFrame:
    """(axis, class, share): the expected share of the kept tokens of each source, language and topic, and the budget of all."""
    names = lambda d: F.array(*map(F.lit, [n for n in sorted(d) if n != OTHER] + [OTHER]))
    nt = len(fit.u)
    cells = probabilities(fit).withColumn("kept", F.col("tokens") * F.col("probability"))
    axes = F.array(*(F.struct(F.lit(a).alias("axis"), c.alias("class")) for a, c in (("all", F.lit("")), ("source", F.col("own_source")), ("language", F.get(names(targets.languages), F.floor(F.col("k") / nt).cast("int"))), ("topic", F.get(names(targets.topics), F.col("k") % nt)))))
    sums = cells.select(F.explode(axes).alias("a"), "kept", "tokens").groupBy("a.axis", "a.class").agg(F.sum("kept").alias("kept"), F.sum("tokens").alias("tokens"))
    whole = sums.where("axis = 'all'").first()
    if whole is None:
        return sums.select("axis", "class", F.lit(0.0).alias("share"))
    return sums.select("axis", "class", F.when(F.col("axis") == "all", F.col("kept") / F.col("tokens")).otherwise(F.col("kept") / (whole["kept"] or 1.0)).alias("share"))


def mix(docs: DataFrame, targets: Targets, topic: Column | None = None) -> DataFrame:
    """Per document of docs (doc_id, text, lang, source): its cell, tokens, factor, probability, and whether it is kept."""
    rows = C.stored(weighed(C.pick(docs, "doc_id", "text", "lang", "source"), targets, topic).drop("text"), "mixing-weights")
    joined = rows.join(probabilities(rake(rows, targets)).drop("tokens"), ["own_source", "k"])
    return joined.select("doc_id", "source", "lang", "topic", "tokens", "factor", "probability", (_chance() < F.col("probability")).alias("kept"))


def sampled(docs: DataFrame, targets: Targets, topic: Column | None = None) -> DataFrame:
    """The kept ones of docs (doc_id, text, lang, source, n_chars), with the same columns."""
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = weighed(C.pick(docs, *names), targets, topic)
    known = probabilities(rake(rows.select("own_source", "k", "tokens"), targets)).drop("tokens")
    return rows.join(known, ["own_source", "k"]).where(_chance() < F.col("probability")).select(*names)


def oracle(targets: Targets) -> str:
    """DuckDB SQL for mix() over documents with default topics and tempered sources: cells as rows, rounds by recursion, a source's factor by windows."""
    text = "coalesce(text, '')"
    any_of = lambda parts: " OR ".join(f"contains({text}, '{p}')" for p in parts)
    topic = "CASE " + " ".join(f"WHEN {any_of(parts)} THEN '{name}'" for name, parts in TOPICS) + f" ELSE '{OTHER}' END"
    listed = lambda column, names: f"CASE WHEN {column} IN ({', '.join(repr(n) for n in sorted(names) if n != OTHER)}) THEN {column} ELSE '{OTHER}' END"
    goals = lambda names: ", ".join(f"('{n}', {x!r}::DOUBLE)" for n, x in names.items() if x > 0)
    six = lambda x: f"floor(({x}) * 1e6 + 0.5) / 1e6"
    step = lambda g, s, m: f"CASE WHEN {g} > {s} AND {m} > 0 THEN ({g} - {s}) / {m} WHEN {s} + {m} > 0 THEN {g} / ({s} + {m}) ELSE 1 END"
    of = lambda x, when, key: f"coalesce(sum(CASE WHEN {when} THEN {x} END) OVER (PARTITION BY {key}), 0)"
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, lang, {topic} AS topic, greatest(len(regexp_extract_all({text}, '{TOKEN}')), 1)::BIGINT AS tokens FROM documents),
e AS MATERIALIZED (SELECT *, coalesce(source, '') AS s, {listed('lang', targets.languages)} AS l, {listed('topic', targets.topics)} AS t FROM d),
gl0(l, gl0) AS (VALUES {goals(targets.languages)}), gt0(t, gt0) AS (VALUES {goals(targets.topics)}),
w0 AS MATERIALIZED (SELECT s, l, t, sum(tokens)::DOUBLE AS w FROM e GROUP BY ALL), n AS (SELECT sum(w) AS n FROM w0),
w1 AS MATERIALIZED (SELECT * FROM w0 JOIN gl0 USING (l) JOIN gt0 USING (t)),
ax AS MATERIALIZED (SELECT 'l' AS a, l AS c, sum(w) AS w, any_value(gl0) AS g FROM w1 GROUP BY 2 UNION ALL SELECT 't', t, sum(w), any_value(gt0) FROM w1 GROUP BY 2),
ag AS MATERIALIZED (SELECT a, c, w, g / sum(g) OVER (PARTITION BY a) AS g FROM ax),
b AS MATERIALIZED (SELECT greatest(least0, least({targets.budget!r}::DOUBLE, most, (SELECT min(w / n / g) FROM ag))) AS b, n, least0 FROM (SELECT n, (SELECT sum(w) FROM w1) / n AS most, least({targets.least!r}::DOUBLE, {targets.budget!r}::DOUBLE, (SELECT sum(w) FROM w1) / n) AS least0 FROM n)),
af AS (SELECT *, (1 - coalesce(sum(cap) OVER (PARTITION BY a ORDER BY cap / g, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(g) OVER (PARTITION BY a ORDER BY cap / g, c ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM (SELECT ag.*, w / n / b AS cap FROM ag, b)),
ah AS MATERIALIZED (SELECT a, c, least(g * coalesce(max(x) FILTER (x * g <= cap * (1 + 1e-12)) OVER (PARTITION BY a), 1e300), cap) AS g FROM af),
gl AS (SELECT c AS l, g AS gl FROM ah WHERE a = 'l'), gt AS (SELECT c AS t, g AS gt FROM ah WHERE a = 't'),
ss AS (SELECT s, sum(w) AS w, pow(sum(w), {targets.temper!r}) AS tw FROM w1 GROUP BY 1),
sc AS (SELECT s, w, tw, w * (1 + b * n / sum(w) OVER ()) / 2 AS cap, b * n AS need FROM ss, b),
so AS (SELECT *, (need - coalesce(sum(cap) OVER (ORDER BY w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(tw) OVER (ORDER BY w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c FROM sc),
gs AS (SELECT s, least(tw * (SELECT arg_min(c, (w, s)) FROM so WHERE c * tw <= cap), cap) AS g FROM so),
r AS (
SELECT 0 AS cut, 1 AS nth, s, l, t, w, g, gl, gt, b AS share, b * n AS need, n, least0, b AS f, 0.0::DOUBLE AS p, 0.0::DOUBLE AS mark, false AS done FROM w1 JOIN gl USING (l) JOIN gt USING (t) JOIN gs USING (s), b
UNION ALL
SELECT CASE WHEN again THEN cut + 1 ELSE cut END, CASE WHEN again THEN 1 ELSE nth + 1 END, s, l, t, w, CASE WHEN again THEN g * greatest(share * {CUT}, least0) / share ELSE g END, gl, gt, CASE WHEN again THEN greatest(share * {CUT}, least0) ELSE share END, CASE WHEN again THEN greatest(share * {CUT}, least0) * n ELSE need END, n, least0,
  CASE WHEN again THEN greatest(share * {CUT}, least0) ELSE f * bl * {step('gt * need', 'ts', 'tm')} END, p, CASE WHEN nth = 1 OR nth % {TRIAL} = 0 THEN err ELSE mark END, stop AND NOT again
FROM (SELECT *, err < {EXACT!r} OR nth = {ROUNDS} OR nth % {TRIAL} = 0 AND err > greatest({TOLERANCE!r}, {NEARER!r} * mark) AS stop, err > {TOLERANCE!r} AND (nth = {ROUNDS} OR nth % {TRIAL} = 0 AND err > {NEARER!r} * mark) AND cut < {CUTS - 1} AND share > least0 AS again, {of('w * p * bl', 'p < 1', 't')} AS tm
 FROM (SELECT *, {step('gl * need', 'ls', 'lm')} AS bl, greatest(max(abs((ls + lm) / need - gl)) OVER (), max(abs((ts + tm0) / need - gt)) OVER ()) AS err
  FROM (SELECT *, {of('w', 'p >= 1', 'l')} AS ls, {of('w * p', 'p < 1', 'l')} AS lm, {of('w', 'p >= 1', 't')} AS ts, {of('w * p', 'p < 1', 't')} AS tm0
   FROM (SELECT * EXCLUDE (p, xi, k), f * coalesce(arg_max(xi, k) FILTER (xi > 0 AND xi * f <= 1) OVER (PARTITION BY s), 1 / min(f) OVER (PARTITION BY s)) AS p
    FROM (SELECT *, (g - (sum(w) OVER (PARTITION BY s) - sum(w) OVER o)) / sum(w * f) OVER o AS xi, row_number() OVER o AS k FROM r WHERE NOT done WINDOW o AS (PARTITION BY s ORDER BY f, l, t ROWS UNBOUNDED PRECEDING))))))),
z AS (SELECT s, l, t, {six('least(1.0, p)')} AS probability, {six('least(1.0, p) / share')} AS factor FROM r WHERE done)
SELECT doc_id, source, lang, topic, tokens, coalesce(factor, 0) AS factor, coalesce(probability, 0) AS probability, ('0x' || substr(md5('mixing ' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < coalesce(probability, 0) AS kept FROM e LEFT JOIN z USING (s, l, t)"""
