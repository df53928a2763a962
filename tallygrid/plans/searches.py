"""SQL of the learners on the planted table: each walks the same steps as a recursive query over states of the search.

A graph is a list of five masks of parents, or a number with a bit for each directed edge. Local scores of all families
and tests of all pairs are tables of their own.
"""

from __future__ import annotations

from itertools import combinations, permutations

from tallygrid.functions.special import chi2_isf
from tallygrid.operators.counting import Family
from tallygrid.plans import fixture as X
from tallygrid.plans import statistics as S

QUERIES: dict = {}
N = 5
SUBSETS = {v: [tuple(u for u in range(N) if m >> u & 1) for m in range(1 << N) if not m >> v & 1] for v in range(N)}
FAMILIES = [Family(v, p) for v in range(N) for p in SUBSETS[v]]
_MASK = ", ".join(f"({i}, {f.var}, {sum(1 << u for u in f.parents)})" for i, f in enumerate(FAMILIES))
_LL = S._LL.format(a=1.0)
_SIZE = "max(c.q) * (max(c.k) - 1)"
#: Local scores as the learners have them by default, alpha 1.
FOLDS = {"bic": (f"{_LL} - 0.5 * ln({S._N}) * {_SIZE}", ""), "aic": (f"{_LL} - {_SIZE}", ""), "ebna": (f"{_LL} - 0.5 * ln({S._N}) * {_SIZE}", "WHERE t.total > 0"), "k2": (S._K2, ""), "k2_pen": (f"{S._K2} - 0.5 * ln({S._N}) * {_SIZE}", "")}


def _scores(kind: str) -> str:
    body, where = FOLDS[kind]
    return f"{X.SQL}, {X.families_sql(FAMILIES)}, fm AS (SELECT * FROM (VALUES {_MASK}) v(fam, var, mask)), sc AS (SELECT fm.var, fm.mask::BIGINT AS mask, s.score FROM (SELECT fam, {body} AS score {S._FROM} {where} GROUP BY fam) s JOIN fm USING (fam))"


def _above(masks: str) -> str:
    """One doubling of the ancestors of each variable."""
    terms = " | ".join(f"(CASE WHEN ({masks}[i + 1] >> {j}) & 1 = 1 THEN {masks}[{j + 1}] ELSE 0 END)" for j in range(N))
    return f"list_transform([0, 1, 2, 3, 4], lambda i: {masks}[i + 1] | {terms})"


_STATES = "FROM (SELECT *, {} AS above FROM (SELECT *, {} AS a1 FROM st))".format(_above("a1"), _above("m"))
_ONE = "(1::BIGINT << {})"
_EMPTY = "[0, 0, 0, 0, 0]::BIGINT[]"
_FROM_MASKS = "SELECT u::INT AS src, v::INT AS dst FROM last, range(5) a(u), range(5) b(v) WHERE (m[v + 1] >> u) & 1 = 1"


def _put(changes: str) -> str:
    return f"list_transform([0, 1, 2, 3, 4], lambda i: {changes})"


def _add_only(kind: str, cap: int, before: bool = False) -> str:
    """Variable by variable, the best parent while the score rises; without cycles, or only parents with a smaller index."""
    legal = "c.u < s.v" if before else "c.u <> s.v AND (s.above[c.u + 1] >> s.v) & 1 = 0"
    return f"""WITH RECURSIVE {_scores(kind)}, st AS (SELECT 0::BIGINT AS v, {_EMPTY} AS m, 0 AS step UNION ALL
SELECT CASE WHEN better THEN v ELSE v + 1 END, CASE WHEN better THEN {_put(f"CASE WHEN i = v THEN m[i + 1] | {_ONE.format('u')} ELSE m[i + 1] END")} ELSE m END, step + 1
FROM (SELECT any_value(s.v) AS v, any_value(s.m) AS m, any_value(s.step) AS step, arg_max(c.u, n.score) AS u, coalesce(max(n.score) > any_value(b.score), false) AS better
  FROM (SELECT * {_STATES}) s JOIN sc b ON b.var = s.v AND b.mask = s.m[s.v + 1]
  LEFT JOIN range(5) c(u) ON {legal} AND (s.m[s.v + 1] >> c.u) & 1 = 0 AND bit_count(s.m[s.v + 1]) < {cap} LEFT JOIN sc n ON n.var = s.v AND n.mask = s.m[s.v + 1] | {_ONE.format('c.u')} WHERE s.v < 5) WHERE v IS NOT NULL),
last AS (SELECT m FROM st ORDER BY step DESC LIMIT 1) {_FROM_MASKS}"""


#: Gains of all legal changes of a state: 0 adds, 1 deletes, 2 turns the edge from u to v.
_MOVES = f"""SELECT s.*, k.op, p.u, p.v, CASE k.op WHEN 0 THEN na.score - nv.score WHEN 1 THEN nd.score - nv.score ELSE nd.score - nv.score + nt.score - nu.score END AS gain
  FROM (SELECT * {_STATES}) s, (VALUES (0), (1), (2)) k(op), (SELECT a.u, b.v FROM range(5) a(u), range(5) b(v) WHERE u <> v) p
  JOIN sc nv ON nv.var = p.v AND nv.mask = s.m[p.v + 1] JOIN sc nu ON nu.var = p.u AND nu.mask = s.m[p.u + 1]
  LEFT JOIN sc na ON na.var = p.v AND na.mask = s.m[p.v + 1] | {_ONE.format('p.u')} LEFT JOIN sc nd ON nd.var = p.v AND nd.mask = s.m[p.v + 1] & ~{_ONE.format('p.u')}
  LEFT JOIN sc nt ON nt.var = p.u AND nt.mask = s.m[p.u + 1] | {_ONE.format('p.v')}
  WHERE CASE k.op WHEN 0 THEN (s.m[p.v + 1] >> p.u) & 1 = 0 AND (s.m[p.u + 1] >> p.v) & 1 = 0 AND (s.above[p.u + 1] >> p.v) & 1 = 0
    WHEN 1 THEN (s.m[p.v + 1] >> p.u) & 1 = 1
    ELSE (s.m[p.v + 1] >> p.u) & 1 = 1 AND NOT ({" OR ".join(f"({w} <> p.v AND (s.m[{w + 1}] >> p.u) & 1 = 1 AND (s.above[p.v + 1] >> {w}) & 1 = 1)" for w in range(N))}) END"""
_CHANGED = _put(f"CASE WHEN i = v THEN CASE WHEN op = 0 THEN m[i + 1] | {_ONE.format('u')} ELSE m[i + 1] & ~{_ONE.format('u')} END WHEN i = u AND op = 2 THEN m[i + 1] | {_ONE.format('v')} ELSE m[i + 1] END")


def _climb(kind: str) -> str:
    """The best change of all while it gains."""
    return f"""WITH RECURSIVE {_scores(kind)}, st AS (SELECT {_EMPTY} AS m, 0 AS step UNION ALL SELECT {_CHANGED}, step + 1
FROM (SELECT any_value(m) AS m, any_value(step) AS step, max(gain) AS gain, arg_max(op, gain) AS op, arg_max(u, gain) AS u, arg_max(v, gain) AS v FROM ({_MOVES})) WHERE gain > 0 AND step < 500),
last AS (SELECT m FROM st ORDER BY step DESC LIMIT 1) {_FROM_MASKS}"""


def _tabu(kind: str, length: int = 10, patience: int = 50) -> str:
    """The best change even if it loses; its inverse is barred for a while unless it leads beyond the best."""
    start = f"(SELECT sum(score) FROM sc WHERE mask = 0)"
    code = "op * 25 + u * 5 + v"
    inverse = "CASE op WHEN 0 THEN 25 + u * 5 + v WHEN 1 THEN u * 5 + v ELSE 50 + v * 5 + u END"
    barred = f"(SELECT *, {code} AS move FROM ({_MOVES}))"
    best = "now + gain > best + 1e-12"
    return f"""WITH RECURSIVE {_scores(kind)}, st AS (SELECT {_EMPTY} AS m, {_EMPTY} AS kept, {start} AS now, {start} AS best, []::BIGINT[] AS held, 0 AS idle, 0 AS step UNION ALL
SELECT changed, CASE WHEN {best} THEN changed ELSE kept END, now + gain, CASE WHEN {best} THEN now + gain ELSE best END, list_append(held, {inverse})[-{length}:], CASE WHEN {best} THEN 0 ELSE idle + 1 END, step + 1
FROM (SELECT *, {_CHANGED} AS changed FROM (SELECT any_value(m) AS m, any_value(kept) AS kept, any_value(now) AS now, any_value(best) AS best, any_value(held) AS held, any_value(idle) AS idle, any_value(step) AS step, max(gain) AS gain, arg_max(op, gain) AS op, arg_max(u, gain) AS u, arg_max(v, gain) AS v
  FROM {barred} WHERE NOT list_contains(held, move) OR now + gain > best)) WHERE gain IS NOT NULL AND idle < {patience} AND step < 500),
last AS (SELECT kept AS m FROM st ORDER BY step DESC LIMIT 1) {_FROM_MASKS}"""


def _exact(kind: str) -> str:
    """The best of all orders, each variable with its best parents among those before it."""
    orders = list(permutations(range(N)))
    seen = ", ".join(f"({o}, {v}, {sum(1 << u for u in order[:k])})" for o, order in enumerate(orders) for k, v in enumerate(order))
    return f"""WITH {_scores(kind)}, o AS (SELECT * FROM (VALUES {seen}) v(o, var, seen)), f AS (SELECT o.o, o.var, max(sc.score) AS s, arg_max(sc.mask, sc.score) AS mask FROM o JOIN sc ON sc.var = o.var AND (sc.mask & ~o.seen::BIGINT) = 0 GROUP BY ALL),
top AS (SELECT o FROM f GROUP BY o ORDER BY sum(s) DESC LIMIT 1) SELECT u::INT AS src, var::INT AS dst FROM f JOIN top USING (o), range(5) a(u) WHERE (mask >> u) & 1 = 1"""


TESTS = [(i, j, z) for k in range(4) for i, j in combinations(range(N), 2) for z in combinations([v for v in range(N) if v not in (i, j)], k)]


def _tests() -> str:
    """``ind``: number, size, pair, condition and whether the pair is independent, in the order in which they are made."""
    crit = ", ".join(f"({k}, {chi2_isf(0.05, k)!r})" for k in range(1, 25))
    listed = ", ".join(f"({r}, {len(z)}, {i}, {j}, {sum(1 << v for v in z)}, {0 if z else (X.CARDS[i] - 1) * (X.CARDS[j] - 1)})" for r, (i, j, z) in enumerate(TESTS))
    return f"""{S._triples(TESTS).removeprefix('WITH ')}, ss AS (SELECT req, z, sum(n * n * nz / (na * nb)) - max(nz) AS s, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS d FROM m GROUP BY req, z),
tt AS (SELECT req, sum(CASE WHEN d > 0 THEN s ELSE 0 END) AS s, sum(d) AS d FROM ss GROUP BY req), lt AS (SELECT * FROM (VALUES {listed}) v(req, size, x, y, z, f)), cr AS (SELECT * FROM (VALUES {crit}) v(d, c)),
ind AS (SELECT req, size, x, y, z::BIGINT AS z, coalesce(tt.s < cr.c, true) AS free FROM lt LEFT JOIN tt USING (req) LEFT JOIN cr ON cr.d = CASE WHEN f > 0 THEN f ELSE tt.d END)"""


_ALL = "[30, 29, 27, 23, 15]::BIGINT[]"
_D = lambda a, b, d="d": f"(({d} >> ({a} * 5 + {b})) & 1 = 1)"
_ADJ = lambda a, b: f"((near[{a} + 1] >> {b}) & 1 = 1)"


def _pc(stable: bool) -> str:
    """Tests in order on the current neighbours, or on those at the start of a size; then colliders and what follows from them."""
    of = "CASE WHEN t.size <> s.size THEN s.near ELSE s.base END" if stable else "s.near"
    rule1 = " OR ".join(f"({b} <> p.v AND {_D(b, 'p.u')} AND NOT {_ADJ(b, 'p.v')})" for b in range(N))
    rule2 = " OR ".join(f"({_D('p.u', w)} AND {_D(w, 'p.v')})" for w in range(N))
    rule3 = " OR ".join(f"({_D(a, 'p.v')} AND {_D(b, 'p.v')} AND {_ADJ('p.u', a)} AND {_ADJ('p.u', b)} AND NOT {_ADJ(a, b)})" for a, b in combinations(range(N), 2))
    return f"""WITH RECURSIVE {_tests()}, st AS (SELECT -1 AS req, 0 AS size, {_ALL} AS near, {_ALL} AS base, false AS removed, false AS stopped, list_transform(range(25), lambda i: -1::BIGINT) AS sep UNION ALL
SELECT req, size, CASE WHEN hit THEN list_transform([0, 1, 2, 3, 4], lambda i: CASE WHEN i = x THEN near[i + 1] & ~{_ONE.format('y')} WHEN i = y THEN near[i + 1] & ~{_ONE.format('x')} ELSE near[i + 1] END) ELSE near END, base,
  hit OR (removed AND size = was), stops, CASE WHEN hit THEN list_transform(range(25), lambda i: CASE WHEN i = x * 5 + y THEN z ELSE sep[i + 1] END) ELSE sep END
FROM (SELECT t.req, t.size, s.size AS was, s.near, CASE WHEN t.size <> s.size THEN s.near ELSE s.base END AS base, s.removed, s.stopped OR (t.size <> s.size AND NOT s.removed) AS stops, s.sep, t.x, t.y, t.z,
  NOT (s.stopped OR (t.size <> s.size AND NOT s.removed)) AND t.free AND (s.near[t.x + 1] >> t.y) & 1 = 1 AND (t.z & ~(({of})[t.x + 1] & ~{_ONE.format('t.y')})) = 0 AS hit
  FROM st s JOIN ind t ON t.req = s.req + 1)),
fin AS (SELECT near, sep FROM st ORDER BY req DESC LIMIT 1),
col AS (SELECT a.a, b.b, c.c FROM fin, range(5) a(a), range(5) b(b), range(5) c(c) WHERE a.a < c.c AND {_ADJ('a.a', 'b.b')} AND {_ADJ('c.c', 'b.b')} AND NOT {_ADJ('a.a', 'c.c')} AND sep[a.a * 5 + c.c + 1] >= 0 AND (sep[a.a * 5 + c.c + 1] >> b.b) & 1 = 0),
dm AS (SELECT near, coalesce((SELECT bit_or((1::BIGINT << (a * 5 + b)) | (1::BIGINT << (c * 5 + b))) FROM col), 0) AS d, 0 AS step FROM fin UNION ALL
SELECT near, d | (1::BIGINT << e), step + 1 FROM (SELECT any_value(near) AS near, any_value(d) AS d, any_value(step) AS step, min(p.u * 5 + p.v) AS e FROM dm, (SELECT a.u, b.v FROM range(5) a(u), range(5) b(v) WHERE u <> v) p
  WHERE {_ADJ('p.u', 'p.v')} AND NOT {_D('p.u', 'p.v')} AND NOT {_D('p.v', 'p.u')} AND ({rule1} OR {rule2} OR {rule3})) WHERE e IS NOT NULL),
lst AS (SELECT near, d FROM dm ORDER BY step DESC LIMIT 1)
SELECT (CASE WHEN fwd THEN u ELSE v END)::INT AS src, (CASE WHEN fwd THEN v ELSE u END)::INT AS dst FROM (SELECT u, v, {_D('u', 'v')} OR NOT {_D('v', 'u')} AS fwd FROM lst, range(5) a(u), range(5) b(v) WHERE u < v AND {_ADJ('u', 'v')})"""


def _grow_shrink() -> str:
    """Blankets of all variables side by side; pairs that are in each other's, directed by index."""
    asked = f"least(s.t, s.v), greatest(s.t, s.v), s.b & ~{_ONE.format('s.v')}"
    return f"""WITH RECURSIVE {_tests()}, st AS (SELECT t, 0 AS phase, 0::BIGINT AS v, 0::BIGINT AS b, 0::BIGINT AS l, false AS grown, 0 AS step FROM range(5) r(t) UNION ALL
SELECT t, CASE WHEN v < 5 OR phase = 0 AND grown THEN phase ELSE phase + 1 END, CASE WHEN v < 5 THEN v + 1 ELSE 0 END,
  CASE WHEN v < 5 AND phase = 0 AND v <> t AND (b >> v) & 1 = 0 AND NOT free THEN b | {_ONE.format('v')} WHEN v < 5 AND phase = 1 AND (l >> v) & 1 = 1 AND free THEN b & ~{_ONE.format('v')} ELSE b END,
  CASE WHEN v = 5 THEN b ELSE l END, CASE WHEN v = 5 THEN false ELSE grown OR (phase = 0 AND v <> t AND (b >> v) & 1 = 0 AND NOT free) END, step + 1
FROM (SELECT s.*, coalesce(i.free, true) AS free FROM st s LEFT JOIN ind i ON (i.x, i.y, i.z) = ({asked}) AND s.v < 5 AND s.v <> s.t WHERE s.phase < 2)),
fin AS (SELECT t, b FROM st WHERE phase = 2) SELECT x.t::INT AS src, y.t::INT AS dst FROM fin x JOIN fin y ON x.t < y.t AND (x.b >> y.t) & 1 = 1 AND (y.b >> x.t) & 1 = 1"""


#: Forest of the pairs in ``ed`` (``i, j, k``: their rank), and its orientation from the colliders in ``col`` (``a, c, b``: a -> c <- b).
_FOREST = "both_ AS (SELECT i, j, k FROM ed UNION ALL SELECT j, i, k FROM ed), reach AS (SELECT e.k AS edge, e.i AS at FROM ed e UNION SELECT r.edge, b.j FROM reach r JOIN both_ b ON b.i = r.at AND b.k < r.edge), tree AS (SELECT i AS u, j AS v FROM ed WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.edge = ed.k AND r.at = ed.j)), tb AS (SELECT u, v FROM tree UNION ALL SELECT v, u FROM tree)"
_INTO = lambda v: "(" + " OR ".join(_D(w, v) for w in range(N)) + ")"
_OUTWARD = f"""dm AS (SELECT coalesce((SELECT bit_or((1::BIGINT << (a * 5 + c)) | (1::BIGINT << (b * 5 + c))) FROM col), 0) AS d, 0 AS step UNION ALL
SELECT d | e, step + 1 FROM (SELECT any_value(d) AS d, any_value(step) AS step, coalesce(bit_or(1::BIGINT << (u * 5 + v)) FILTER (led AND u = lead), bit_or(1::BIGINT << (u * 5 + v)) FILTER (u = root)) AS e
  FROM (SELECT *, max(u) FILTER (led) OVER () AS lead, min(u) OVER () AS root FROM (SELECT dm.*, tb.u, tb.v, {_INTO('tb.u')} AS led FROM dm, tb WHERE NOT {_D('tb.u', 'tb.v')} AND NOT {_D('tb.v', 'tb.u')}))) WHERE e IS NOT NULL),
lst AS (SELECT d FROM dm ORDER BY step DESC LIMIT 1) SELECT u::INT AS src, v::INT AS dst FROM lst, tb WHERE {_D('u', 'v')} AND NOT {_D('v', 'u')}"""
_CRITS = "CASE WHEN i = 4 OR j = 4 THEN {} ELSE {} END"
_STRATA = {(k, c): chi2_isf(0.05, k * c) for k in (1, 2) for c in (2, 3)}
TRIPLES = [(i, j, (z,)) for i, j in combinations(range(N), 2) for z in range(N) if z not in (i, j)]


def _pairs_sql() -> str:
    return f"pr AS ({S._PAIR}), pm AS (SELECT *, sum(n) OVER (PARTITION BY i, j, a) AS na, sum(n) OVER (PARTITION BY i, j, b) AS nb, sum(n) OVER (PARTITION BY i, j) AS t FROM pr), mi AS (SELECT i, j, greatest(0, sum(n / t * ln(n * t / (na * nb)))) AS mi, max(t) AS t FROM pm GROUP BY i, j)"


def _rebane_pearl() -> str:
    crit = _CRITS.format(chi2_isf(0.05, 2), chi2_isf(0.05, 1))
    return f"""WITH RECURSIVE {_tests()}, {_pairs_sql()}, ed AS (SELECT i, j, row_number() OVER (ORDER BY mi DESC, i, j) AS k FROM mi WHERE 2 * t * mi > {crit}), {_FOREST},
col AS (SELECT p.u AS a, p.v AS c, q.u AS b FROM tb p JOIN tb q ON p.v = q.v AND p.u < q.u JOIN ind ON ind.size = 0 AND ind.x = p.u AND ind.y = q.u AND ind.free), {_OUTWARD}"""


def _lpa(marginal: bool) -> str:
    crit = _CRITS.format(chi2_isf(0.05, 2), chi2_isf(0.05, 1))
    third = ", ".join(f"({r}, {i}, {j}, {z[0]}, {_STRATA[(X.CARDS[i] - 1) * (X.CARDS[j] - 1), X.CARDS[z[0]]]!r})" for r, (i, j, z) in enumerate(TRIPLES))
    cmi = f"{S._triples(TRIPLES).removeprefix('WITH ')}, nm AS (SELECT * FROM (VALUES {third}) v(req, i, j, z, crit)), cmi AS (SELECT nm.*, g.c FROM nm JOIN (SELECT req, greatest(0, sum(n / t * ln(n * nz / (na * nb)))) AS c FROM m GROUP BY req) g USING (req))"
    kept = "wk AS (SELECT i, j, mi AS worst FROM mi WHERE 2 * t * mi > {})".format(crit) if marginal else f"wk AS (SELECT mi.i, mi.j, least(max(mi.mi), min(cmi.c)) AS worst FROM mi JOIN cmi USING (i, j) WHERE 2 * mi.t * mi.mi > {crit} GROUP BY mi.i, mi.j HAVING bool_and(2 * mi.t * cmi.c >= cmi.crit))"
    return f"""WITH RECURSIVE {cmi}, {_pairs_sql()}, {kept}, ed AS (SELECT i, j, row_number() OVER (ORDER BY worst DESC, i, j) AS k FROM wk), {_FOREST},
col AS (SELECT p.u AS a, p.v AS c, q.u AS b FROM tb p JOIN tb q ON p.v = q.v AND p.u < q.u JOIN cmi ON cmi.i = p.u AND cmi.j = q.u AND cmi.z = p.v JOIN mi ON mi.i = p.u AND mi.j = q.u WHERE cmi.c > mi.mi), {_OUTWARD}"""


_EVERY = [tuple(v for v in range(N) if m >> v & 1) for m in range(1, 1 << N)]
_EVIDENCE = " UNION ALL ".join(f"SELECT {sum(1 << v for v in s)} AS mask, {X.index_sql(s)} AS c, sum(w) AS n, {X.size(s)} AS q FROM cfg GROUP BY ALL" for s in _EVERY)


def _clusters() -> str:
    """The pair of clusters with the largest log Bayes factor is joined while it is positive; the joined one goes to the end."""
    gain = "ab.score - ea.score - eb.score"
    return f"""WITH RECURSIVE {X.SQL}, ev0 AS ({_EVIDENCE}), ev AS (SELECT mask::BIGINT AS mask, sum(lgamma(n + 1.0 / q) - lgamma(1.0 / q)) + lgamma(1.0) - lgamma(sum(n) + 1.0) AS score FROM ev0 GROUP BY mask),
st AS (SELECT [1, 2, 4, 8, 16]::BIGINT[] AS c, -1 AS step, 0::BIGINT AS a, 0::BIGINT AS b, 0.0::DOUBLE AS s UNION ALL
SELECT list_append(list_filter(c, lambda x: x <> a AND x <> b), a | b), step + 1, a, b, g FROM (SELECT any_value(c) AS c, any_value(step) AS step, arg_max(a, g) AS a, arg_max(b, g) AS b, max(g) AS g FROM (
  SELECT st.c, st.step, st.c[i.i] AS a, st.c[j.i] AS b, {gain} AS g FROM st, range(1, 6) i(i), range(1, 6) j(i) JOIN ev ea ON ea.mask = st.c[i.i] JOIN ev eb ON eb.mask = st.c[j.i] JOIN ev ab ON ab.mask = st.c[i.i] | st.c[j.i] WHERE i.i < j.i AND j.i <= len(st.c))) WHERE g > 0)
SELECT step, a::INT AS a, b::INT AS b, round(s, 4) AS log_bf FROM st WHERE step >= 0"""


def _mean_field() -> str:
    """Coordinate steps on the planted network given x2 = 1, to the fixed point; a, b, c: shares of state 1 of x0, x1, x3."""
    p = lambda v, q, s: f"p{v}{q}{s}"
    logs = ", ".join(f"max(ln(p)) FILTER (var = {v} AND pcfg = {q} AND state = {s}) AS {p(v, q, s)}" for v, qs in ((0, 1), (1, 2), (2, 2), (3, 2)) for q in range(qs) for s in range(2))
    share = lambda zero, one: f"1 / (1 + exp(({zero}) - ({one})))"
    x0 = share(*[f"{p(0, 0, s)} + (1 - b) * {p(1, s, 0)} + b * {p(1, s, 1)} + (1 - c) * {p(3, s, 0)} + c * {p(3, s, 1)}" for s in (0, 1)])
    x1 = share(*[f"(1 - a) * {p(1, 0, s)} + a * {p(1, 1, s)} + {p(2, s, 1)}" for s in (0, 1)])
    x3 = share(*[f"(1 - a) * {p(3, 0, s)} + a * {p(3, 1, s)}" for s in (0, 1)])
    cpd = f"{X.SQL}, {X.families_sql(X.NETWORK)}, cpd AS (SELECT c.var, c.pcfg, c.state, (c.n + 1.0 / c.k) / (t.total + 1.0) AS p FROM cell c JOIN cfgt t USING (fam, pcfg))"
    return f"""WITH RECURSIVE {cpd}, lg AS (SELECT {logs} FROM cpd), st AS (SELECT 0.5::DOUBLE AS a, 0.5::DOUBLE AS b, 0.5::DOUBLE AS c, 0 AS step UNION ALL
SELECT a, b, {x3}, step + 1 FROM (SELECT a, {x1} AS b, c, step FROM (SELECT {x0} AS a, b, c, step FROM st, lg), lg), lg WHERE step < 200), z AS (SELECT * FROM st ORDER BY step DESC LIMIT 1)
SELECT v, s, round(p, 6) AS p FROM (SELECT unnest([0, 0, 1, 1, 2, 2, 3, 3]) AS v, unnest([0, 1, 0, 1, 0, 1, 0, 1]) AS s, unnest([1 - a, a, 1 - b, b, 0.0, 1.0, 1 - c, c]) AS p FROM z UNION ALL SELECT var, state::INT, p FROM cpd WHERE var = 4)"""


SQL = {
    "variable_clusters": _clusters(), "mean_field_marginals": _mean_field(),
    "learn_bic": _add_only("bic", 6), "learn_aic": _add_only("aic", 6), "learn_ebna": _add_only("ebna", 2), "learn_k2_pen": _add_only("k2_pen", 6), "learn_boa": _add_only("k2", 3, True),
    "learn_stable_hc": _climb("bic"), "learn_tabu": _tabu("bic"), "learn_levelwise": _exact("bic"), "learn_pc": _pc(False), "learn_stable_pc": _pc(True), "learn_gs": _grow_shrink(),
    "learn_rebane_pearl": _rebane_pearl(), "learn_lpa": _lpa(False), "learn_lpa_marginal": _lpa(True),
}
