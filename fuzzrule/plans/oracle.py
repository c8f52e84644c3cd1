"""Portable SQL text of every pipeline stage, for the DuckDB oracle.

``SqlChain`` emits a ``WITH`` chain over the raw driver tables that
recomputes the whole plan relationally: indexing by count, min-max
scaling, right-closed labels, one grouped cell aggregate, the mask cross
join, the fused combine/resolve aggregate, window rank filters, a rows x
rules cross join with ``row_number`` arg-max for the winning rule, and the
precision selection.  The text is independent of the Spark code paths
(which use different operators for the same results), so agreement is a
real check.

Doubles: every constant is written as ``CAST('<repr>' AS DOUBLE)`` so both
engines parse the same IEEE value; products run in feature order.
"""

from __future__ import annotations

from dataclasses import dataclass

from itertools import combinations

from fuzzrule.params import RuleParams

# the constants of the method, stated here again so that an error in the
# engine's cannot hide
STABLE_OFFSET = 0.5123
RELAX_STEP = 0.1


def width(n: int) -> float:
    """Distance of the centres of n evenly spaced triangles on 0..1."""
    return 1 / (n - 1)


def cut_points(n: int) -> list[float]:
    """Halfway between centres; the outer ones a tenth beyond the range."""
    return [-0.1] + [(2 * k - 1) / (2 * (n - 1)) for k in range(1, n)] + [1.1]


def subset_masks(d: int, least: int, most: int) -> list[list[int]]:
    return [[int(j in pick) for j in range(d)] for k in range(least, min(d, most) + 1)
            for pick in combinations(range(d), k)]


def dbl(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


@dataclass(frozen=True)
class Dataset:
    name: str
    select: str        # SQL producing rid, [id], x0.. (numeric), c0.. (string), ystr
    n_num: int
    n_cat: int
    has_id: bool
    score: str | None = None   # all rows to score (no ystr); default: select


LINEITEM = Dataset(
    "lineitem",
    "SELECT row_number() OVER () AS rid, l_quantity AS x0, l_extendedprice AS x1, "
    "l_discount AS x2, l_tax AS x3, CAST(l_linestatus AS VARCHAR) AS ystr FROM lineitem",
    4, 0, False)

def _documents(n_chars: str, upper: str, lang: str) -> str:
    return (
        f"SELECT d.doc_id AS rid, d.doc_id AS id, CAST({n_chars} AS DOUBLE) AS x0, "
        "CAST(length(d.text) - length(replace(d.text, chr(10), '')) + 1 AS DOUBLE) AS x1, "
        f"{upper} AS x2, "
        "CAST(len(list_distinct(regexp_extract_all(d.text, '\\w+'))) AS DOUBLE) "
        "/ CAST(greatest(len(regexp_extract_all(d.text, '\\w+')), 1) AS DOUBLE) AS x3, "
        f"{lang} AS c0")


_UPPER = ("CAST(length(regexp_replace(d.text, '[^A-Z]', '', 'g')) AS DOUBLE) "
          "/ CAST(greatest(length(d.text), 1) AS DOUBLE)")
_LABELLED = ", CAST(l.quality AS VARCHAR) AS ystr FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
_PLAIN = _documents("d.n_chars", _UPPER, "d.lang")
DOCUMENTS = Dataset("documents", _PLAIN + _LABELLED, 4, 1, True, _PLAIN + " FROM documents d")

# missing numbers are null here, whether null or NaN in the table
_M_CHARS = "CASE WHEN d.doc_id % 7 <> 0 THEN d.n_chars END"
_M_UPPER = f"CASE WHEN d.doc_id % 11 <> 0 THEN {_UPPER} END"
MISSING = Dataset("missing", _documents(_M_CHARS, _M_UPPER, "d.lang") + _LABELLED, 4, 1, True,
                  _documents(_M_CHARS, _M_UPPER, "CASE WHEN d.doc_id % 13 = 0 THEN 'xx' ELSE d.lang END")
                  + " FROM documents d")

_DIMS = ", ".join(f"CAST(embedding[{j + 1}] AS DOUBLE) AS x{j}" for j in range(64))
EMBEDDINGS = Dataset(
    "embeddings",
    f"SELECT vec_id AS rid, vec_id AS id, {_DIMS}, CAST(CAST(label < 5 AS INTEGER) AS VARCHAR) AS ystr FROM embeddings",
    64, 0, True)

FLAGS = Dataset(
    "flags",
    "SELECT d.doc_id AS rid, d.doc_id AS id, CAST(d.n_chars AS DOUBLE) AS x0, CAST(contains(d.text, ' | ') AS INTEGER) AS x1, "
    "CAST(contains(d.text, chr(10)) AS INTEGER) AS x2, CAST(d.n_chars > 1000 AS INTEGER) AS x3" + _LABELLED,
    4, 0, True)

DATASETS = {"L": LINEITEM, "D": DOCUMENTS, "E": EMBEDDINGS, "M": MISSING, "B": FLAGS}


def trimf_sql(z: str, a: str, b: str, c: str) -> str:
    zero = dbl(0.0)
    rise, fall = f"({z} - {a}) / ({b} - {a})", f"({c} - {z}) / ({c} - {b})"
    # a null slope (missing value or prototype) is not above 0
    return f"(CASE WHEN {rise} > 0 AND {fall} > 0 THEN least({rise}, {fall}) ELSE {zero} END)"


def factor_sql(lab: str, z: str, n: int, proto: str | None = None) -> str:
    h = dbl(width(n))
    ld = f"CAST({lab} AS DOUBLE)"
    a, b, c = f"(({ld} - {dbl(2.0)}) * {h})", f"(({ld} - {dbl(1.0)}) * {h})", f"({ld} * {h})"
    if proto is not None:
        tu = f"({proto} - {b})"
        a, b, c = f"({a} + {tu})", f"({b} + {tu})", f"({c} + {tu})"
    return f"(CASE WHEN {lab} = 0 THEN {dbl(1.0)} ELSE {trimf_sql(z, a, b, c)} END)"


def match_sql(labs: list[str], zs: list[str], n: int, protos: list[str] | None = None) -> str:
    fs = [factor_sql(l, z, n, None if protos is None else protos[j])
          for j, (l, z) in enumerate(zip(labs, zs))]
    return "(" + " * ".join(fs) + ")"


def label_sql(z: str, n: int) -> str:
    bins = cut_points(n)
    parts = [f"WHEN {z} <= {dbl(b)} THEN {k}" for k, b in enumerate(bins)]
    return f"(CASE {' '.join(parts)} WHEN {z} IS NOT NULL THEN {n + 1} END)"


def r6(x: str, p: int = 6) -> str:
    """Same grid as ``stable_round``."""
    sc = dbl(float(10 ** p))
    return f"(CAST(floor(({x}) * {sc} + {dbl(STABLE_OFFSET)}) AS DOUBLE) / {sc})"


def round_at_sql(x: str, p: int) -> str:
    """Same as ``round_at``: floor(x * 10^p + 0.5) / 10^p, null -> 0."""
    sc = dbl(float(10 ** p))
    return f"COALESCE(CAST(floor(({x}) * {sc} + {dbl(0.5)}) AS DOUBLE) / {sc}, {dbl(0.0)})"


class SqlChain:
    """WITH-chain builder for one dataset and parameter set."""

    def __init__(self, ds: Dataset, params: RuleParams | None = None, suffix: str = "",
                 train_filter: str | None = None):
        self.ds = ds
        self.p = params or RuleParams()
        self.s = suffix
        self.train_filter = train_filter
        self.d = ds.n_num + ds.n_cat
        self.ctes: list[tuple[str, str]] = []
        self._done: set[str] = set()

    # names of CTEs carry the suffix so several chains (folds) can share one WITH
    def t(self, name: str) -> str:
        return f"{name}{self.s}"

    def add(self, name: str, sql: str) -> str:
        full = self.t(name)
        if full not in self._done:
            self.ctes.append((full, sql))
            self._done.add(full)
        return full

    def ants(self, alias: str = "") -> list[str]:
        pre = f"{alias}." if alias else ""
        return [f"{pre}a{j}" for j in range(self.d)]

    def ant_key(self, alias: str = "") -> str:
        return "concat_ws('|', " + ", ".join(f"CAST({a} AS VARCHAR)" for a in self.ants(alias)) + ")"

    def with_sql(self, final: str) -> str:
        return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in self.ctes) + "\n" + final

    # --------------------------------------------------------------- stages
    def src(self) -> str:
        return self.add("src", self.ds.select)

    def index(self) -> None:
        src = self.src()
        train = self.train(src)
        for k in range(self.ds.n_cat):
            self.add(f"cidx{k}", f"SELECT c{k} AS v, CAST(row_number() OVER (ORDER BY count(*) DESC, c{k}) - 1 "
                                 f"AS DOUBLE) AS idx FROM {train} WHERE c{k} IS NOT NULL GROUP BY c{k}")
        self.add("yidx", f"SELECT ystr AS v, CAST(row_number() OVER (ORDER BY count(*) DESC, ystr) - 1 "
                         f"AS DOUBLE) AS idx FROM {train} WHERE ystr IS NOT NULL GROUP BY ystr")

    def train(self, src: str) -> str:
        if self.train_filter is None:
            return src
        return self.add("train_src", f"SELECT * FROM {src} WHERE {self.train_filter}")

    def prepared(self, which: str = "train") -> str:
        """Indexed rows: rid, [id], f0.., y (training rows or all rows)."""
        self.index()
        src = self.src()
        base = self.train(src) if which == "train" else src
        name = {"train": "prep", "all": "prep_all", "score": "prep_score"}[which]
        if which == "score":
            base = self.add("src_score", self.ds.score or self.ds.select)
        cols = ["s.rid"] + (["s.id"] if self.ds.has_id else [])
        cols += [f"CAST(s.x{j} AS DOUBLE) AS f{j}" for j in range(self.ds.n_num)]
        cols += [f"ci{k}.idx AS f{self.ds.n_num + k}" for k in range(self.ds.n_cat)]
        cols += ["yi.idx AS y"] if which != "score" else ["NULL AS y"]
        joins = " ".join(f"JOIN {self.t(f'cidx{k}')} ci{k} ON s.c{k} = ci{k}.v" for k in range(self.ds.n_cat))
        notnull = " AND ".join([f"s.x{j} IS NOT NULL" for j in range(self.ds.n_num)] or ["TRUE"])
        if which == "score":  # a missing number has membership 0
            return self.add(name, f"SELECT {', '.join(cols)} FROM {base} s {joins}")
        return self.add(name, f"SELECT {', '.join(cols)} FROM {base} s {joins} "
                              f"JOIN {self.t('yidx')} yi ON s.ystr = yi.v WHERE {notnull}")

    def stats(self) -> str:
        prep = self.prepared()
        parts = ["count(*) AS n", "count_if(y = 0) AS n0"]
        for j in range(self.d):
            parts += [f"min(f{j}) AS mn{j}", f"max(f{j}) AS mx{j}"]
        self.add("stats", f"SELECT {', '.join(parts)} FROM {prep}")
        return self.add("maj", f"SELECT CASE WHEN n0 >= n - n0 THEN {dbl(0.0)} ELSE {dbl(1.0)} END AS maj, "
                               f"n, n0 FROM {self.t('stats')}")

    def fuzzified(self, which: str = "train") -> str:
        self.stats()
        prep = self.prepared(which)
        name = {"train": "fz", "all": "fz_all", "score": "fz_score"}[which]
        cols = ["p.rid"] + (["p.id"] if self.ds.has_id else [])
        for j in range(self.d):
            cols.append(f"CASE WHEN st.mx{j} = st.mn{j} THEN {dbl(0.5)} "
                        f"ELSE (p.f{j} - st.mn{j}) / (st.mx{j} - st.mn{j}) END AS z{j}")
        cols.append("p.y")
        scaled = self.add(f"sc_{name}", f"SELECT {', '.join(cols)} FROM {prep} p CROSS JOIN {self.t('stats')} st")
        labs = [f"{label_sql(f'z{j}', self.p.n_labels)} AS l{j}" for j in range(self.d)]
        return self.add(name, f"SELECT *, {', '.join(labs)} FROM {scaled}")

    def cells(self) -> str:
        fz = self.fuzzified()
        d = self.d
        aggs = ["count_if(y = 0) AS cp", "count_if(y = 1) AS cn"]
        aggs += [f"avg(CASE WHEN y = 0 THEN z{j} END) AS m0_{j}" for j in range(d)]
        aggs += [f"avg(CASE WHEN y = 1 THEN z{j} END) AS m1_{j}" for j in range(d)]
        keys = ", ".join(f"l{j}" for j in range(d))
        g = self.add("cellagg", f"SELECT {', '.join(f'l{j} AS a{j}' for j in range(d))}, {', '.join(aggs)} "
                                f"FROM {fz} GROUP BY {keys}")
        win0 = "((g.cp > g.cn) OR (g.cp = g.cn AND m.maj = 0))"
        pure = "(g.cp = 0 OR g.cn = 0)"
        cols = [f"g.a{j}" for j in range(d)]
        cols += [f"CASE WHEN {win0} THEN {dbl(0.0)} ELSE {dbl(1.0)} END AS cls",
                 f"(NOT {pure}) AS two_mass",
                 "CAST(greatest(g.cp, g.cn) AS DOUBLE) AS sp1",
                 "CAST(least(g.cp, g.cn) AS DOUBLE) AS sp2"]
        cols += [f"CASE WHEN {win0} THEN g.m0_{j} ELSE g.m1_{j} END AS p1_{j}" for j in range(d)]
        cols += [f"CASE WHEN {pure} THEN (CASE WHEN {win0} THEN g.m0_{j} ELSE g.m1_{j} END) "
                 f"ELSE (CASE WHEN {win0} THEN g.m1_{j} ELSE g.m0_{j} END) END AS p2_{j}" for j in range(d)]
        return self.add("cells", f"SELECT {', '.join(cols)} FROM {g} g CROSS JOIN {self.t('maj')} m")

    def cells_filtered(self) -> str:
        cells = self.cells()
        if not self.p.use_filtering:
            return cells
        if self.p.filtering_ths == -1:
            ths = (f"(SELECT floor(CAST(m.n - 1 AS DOUBLE) / CAST((SELECT count(*) FROM {cells}) AS DOUBLE)) "
                   f"FROM {self.t('maj')} m)")
        else:
            ths = dbl(self.p.filtering_ths)
        return self.add("cellsf", f"SELECT * FROM {cells} WHERE sp1 > {ths}")

    def expanded(self) -> str:
        cells = self.cells_filtered()
        d = self.d
        masks = subset_masks(d, self.p.min_length, self.p.max_length)
        vals = ", ".join("(" + ", ".join(str(v) for v in m) + ")" for m in masks)
        mk = self.masks(self.add("masks", f"SELECT * FROM (VALUES {vals}) AS t({', '.join(f'm{j}' for j in range(d))})"))
        cols = [f"c.a{j} * k.m{j} AS a{j}" for j in range(d)] + ["c.cls", "c.sp1", "c.sp2"]
        cols += [f"c.p1_{j} * c.sp1 AS w1_{j}" for j in range(d)]
        cols += [f"c.p2_{j} * c.sp2 AS w2_{j}" for j in range(d)]
        return self.add("sub", f"SELECT {', '.join(cols)} FROM {cells} c CROSS JOIN {mk} k")

    def masks(self, table: str) -> str:
        return table

    def combined(self) -> str:
        sub = self.expanded()
        d = self.d
        keys = ", ".join(f"a{j}" for j in range(d))
        aggs = ["sum(sp1) AS s1", "sum(sp2) AS s2", "count(*) AS n_src"]
        aggs += [f"sum(w1_{j}) AS W1_{j}" for j in range(d)] + [f"sum(w2_{j}) AS W2_{j}" for j in range(d)]
        g = self.add("combagg", f"SELECT {keys}, cls, {', '.join(aggs)} FROM {sub} GROUP BY {keys}, cls")
        cols = [f"a{j}" for j in range(d)] + ["cls", "s1", "s2", "n_src",
                                             "CASE WHEN s1 + s2 > 0 THEN s1 / (s1 + s2) END AS conf"]
        cols += [f"CASE WHEN s1 > 0 THEN W1_{j} / s1 END AS q1_{j}" for j in range(d)]
        cols += [f"CASE WHEN s2 > 0 THEN W2_{j} / s2 WHEN n_src = 1 THEN "
                 f"(CASE WHEN s1 > 0 THEN W1_{j} / s1 END) END AS q2_{j}" for j in range(d)]
        return self.add("comb", f"SELECT {', '.join(cols)} FROM {g}")

    def resolved(self) -> str:
        sub = self.expanded()
        self.stats()
        d, n = self.d, self.p.n_labels
        keys = ", ".join(f"a{j}" for j in range(d))
        aggs = []
        for c in (0, 1):
            aggs += [f"sum(CASE WHEN cls = {c} THEN sp1 END) AS s1_{c}",
                     f"sum(CASE WHEN cls = {c} THEN sp2 END) AS s2_{c}",
                     f"count_if(cls = {c}) AS nc_{c}"]
            aggs += [f"sum(CASE WHEN cls = {c} THEN w1_{j} END) AS W1_{c}_{j}" for j in range(d)]
            aggs += [f"sum(CASE WHEN cls = {c} THEN w2_{j} END) AS W2_{c}_{j}" for j in range(d)]
        g = self.add("resagg", f"SELECT {keys}, {', '.join(aggs)} FROM {sub} GROUP BY {keys}")
        qcols = []
        for c in (0, 1):
            for j in range(d):
                q1 = f"(CASE WHEN nc_{c} > 0 AND s1_{c} <> 0 THEN W1_{c}_{j} / s1_{c} END)"
                qcols.append(f"{q1} AS q1_{c}_{j}")
                qcols.append(f"(CASE WHEN s2_{c} > 0 THEN W2_{c}_{j} / s2_{c} WHEN nc_{c} = 1 THEN {q1} END) "
                             f"AS q2_{c}_{j}")
        q = self.add("resq", f"SELECT *, {', '.join(qcols)} FROM {g}")
        ants = [f"a{j}" for j in range(d)]
        m0 = match_sql(ants, [f"q1_0_{j}" for j in range(d)], n)
        m1 = match_sql(ants, [f"q1_1_{j}" for j in range(d)], n)
        mm = self.add("resm", f"SELECT *, {m0} AS mm0, {m1} AS mm1 FROM {q}")
        both = "(r.nc_0 > 0 AND r.nc_1 > 0)"
        rw0 = "(CASE WHEN r.mm0 + r.mm1 <> 0 THEN (r.mm0 - r.mm1) / (r.mm0 + r.mm1) END)"
        tie = f"({both} AND ({rw0} IS NULL OR abs({rw0}) <= {dbl(self.p.tie_eps)}))"
        win0 = (f"(CASE WHEN NOT {both} THEN r.nc_0 > 0 WHEN {tie} THEN m.maj = 0 "
                f"ELSE {rw0} > 0 END)")
        w = self.add("resw", f"SELECT r.*, {win0} AS win0, {both} AS both_cls, {tie} AS tie, {rw0} AS rw0 "
                             f"FROM {mm} r CROSS JOIN {self.t('maj')} m")

        def pick(x):
            return f"(CASE WHEN win0 THEN {x}_0 ELSE {x}_1 END)"
        s1w, s2w = pick("s1"), pick("s2")
        conf_single = f"(CASE WHEN {s1w} + {s2w} <> 0 THEN {s1w} / ({s1w} + {s2w}) END)"
        conf_conf = f"({s1w} / (s1_0 + s1_1))"
        pk = "q2" if self.p.prototype == "second" else "q1"
        cols = ants + [
            f"CASE WHEN win0 THEN {dbl(0.0)} ELSE {dbl(1.0)} END AS cls",
            f"CASE WHEN NOT both_cls THEN {conf_single} WHEN tie THEN {dbl(0.0)} ELSE abs(rw0) END AS rw",
            f"{s1w} AS sup",
            f"CASE WHEN NOT both_cls THEN {conf_single} ELSE {conf_conf} END AS conf",
            f"{s1w} AS s1", f"{s2w} AS s2", "both_cls AS conflict"]
        cols += [f"(CASE WHEN win0 THEN {pk}_0_{j} ELSE {pk}_1_{j} END) AS proto_{j}" for j in range(d)]
        cols.append("(" + " + ".join(f"CAST(a{j} <> 0 AS INTEGER)" for j in range(d)) + ") AS len")
        return self.add("resolved", f"SELECT {', '.join(cols)} FROM {w}")

    def ranked(self) -> str:
        res = self.resolved()
        order_a = ", ".join(f"a{j}" for j in range(self.d))
        if self.p.rank_by == "class_length":
            inner = (f"SELECT *, row_number() OVER (PARTITION BY cls, len ORDER BY conf DESC, {order_a}) - 1 AS pos, "
                     f"count(*) OVER (PARTITION BY cls, len) AS cnt FROM {res}")
            keep = "pos <= floor(CAST(cnt AS DOUBLE) / 2)"
        else:
            inner = (f"SELECT *, row_number() OVER (PARTITION BY cls ORDER BY conf, {order_a}) - 1 AS pos, "
                     f"count(*) OVER (PARTITION BY cls) AS cnt FROM {res}")
            keep = "pos >= floor(CAST(cnt AS DOUBLE) / 2)"
        r = self.add("rankedraw", f"SELECT * EXCLUDE (pos, cnt) FROM ({inner}) WHERE {keep}")
        return self.add("ranked", f"SELECT *, CAST(row_number() OVER (ORDER BY cls, conf, {order_a}) - 1 AS INTEGER) "
                                  f"AS rule_id FROM {r}")

    def winners(self, rules: str, rows: str, name: str, shifted: bool = False) -> str:
        """Per row: the first rule (by rule_id) with the largest positive degree."""
        d, n = self.d, self.p.n_labels
        md = match_sql([f"r.a{j}" for j in range(d)], [f"s.z{j}" for j in range(d)], n,
                       [f"r.proto_{j}" for j in range(d)] if shifted else None)
        if self.p.use_rw:
            md = f"{md} * r.rw"
        x = self.add(f"{name}_md", f"SELECT s.rid, s.y, r.rule_id, r.cls, {md} AS md FROM {rows} s CROSS JOIN {rules} r")
        return self.add(name, f"SELECT rid, y, rule_id, cls, md FROM (SELECT *, row_number() OVER "
                              f"(PARTITION BY rid ORDER BY md DESC, rule_id) AS rn FROM {x} WHERE md > 0) WHERE rn = 1")

    def class_sums(self, rules: str, rows: str, name: str, shifted: bool = False) -> str:
        d, n = self.d, self.p.n_labels
        md = match_sql([f"r.a{j}" for j in range(d)], [f"s.z{j}" for j in range(d)], n,
                       [f"r.proto_{j}" for j in range(d)] if shifted else None)
        if self.p.use_rw:
            md = f"{md} * r.rw"
        x = self.add(f"{name}_md", f"SELECT s.rid, r.cls, {md} AS md FROM {rows} s CROSS JOIN {rules} r")
        return self.add(name, f"SELECT rid, sum(CASE WHEN cls = 0 THEN md ELSE {dbl(0.0)} END) AS s0, "
                              f"sum(CASE WHEN cls = 1 THEN md ELSE {dbl(0.0)} END) AS s1 FROM {x} GROUP BY rid")

    def with_wins(self) -> str:
        ranked = self.ranked()
        win = self.winners(ranked, self.fuzzified(), "trainwin")
        wins = self.add("wins", f"SELECT rule_id, count(*) AS n_win, count_if(cls = y) AS n_correct "
                                f"FROM {win} GROUP BY rule_id")
        return self.add("used", f"SELECT r.*, w.n_win, w.n_correct FROM {ranked} r JOIN {wins} w "
                                f"ON r.rule_id = w.rule_id")

    def final(self) -> str:
        used = self.with_wins()
        thr = self.p.precision
        steps = [thr]
        t = thr - RELAX_STEP
        while t >= 0:
            steps.append(t)
            t = t - RELAX_STEP
        steps.append(t)
        case = " ".join(f"WHEN mp > {dbl(s)} THEN {dbl(s)}" for s in steps)
        prec = "CAST(n_correct AS DOUBLE) / CAST(n_win AS DOUBLE)"
        pth = self.add("pth", f"SELECT cls, CASE {case} END AS th FROM "
                              f"(SELECT cls, max({prec}) AS mp FROM {used} GROUP BY cls)")
        sel = self.add("selected", f"SELECT u.* FROM {used} u JOIN {pth} p ON u.cls = p.cls "
                                   f"WHERE CAST(u.n_correct AS DOUBLE) / CAST(u.n_win AS DOUBLE) > p.th")
        return self.add("final", f"SELECT * FROM {sel}")

    def gm_final(self) -> str:
        """GM-guided selection: closed-form thresholds per step, every step
        scored on the training rows at once, the original's stop rule."""
        import math
        used = self.with_wins()
        rate = self.p.step
        cap = int(math.ceil(1.0 / rate)) + 2
        r = dbl(rate)
        ratio = "(CAST(n_correct AS DOUBLE) / sup)"
        mx = self.add("gmmax", f"SELECT max(CASE WHEN cls = 0 THEN {ratio} END) AS mp, "
                               f"max(CASE WHEN cls = 1 THEN {ratio} END) AS mn FROM {used}")
        raw_p, raw_n = [f"(mp - {r} * mp)"], [f"(mn - {r} * mn)"]
        for _ in range(cap):
            raw_p.append(f"({raw_p[-1]} - {r} * mp)")
            raw_n.append(f"({raw_n[-1]} - {r} * mn)")
        eff_p, eff_n = [raw_p[0]], [raw_n[0]]
        for i in range(1, cap + 1):
            eff_p.append(f"(CASE WHEN {raw_p[i]} + {r} * mp > 0 THEN {raw_p[i]} ELSE {eff_p[-1]} END)")
            eff_n.append(f"(CASE WHEN {raw_n[i]} + {r} * mn > 0 THEN {raw_n[i]} ELSE {eff_n[-1]} END)")
        steps = self.add("gmsteps", " UNION ALL ".join(
            f"SELECT {i} AS step, {eff_p[i]} AS ep, {eff_n[i]} AS en, "
            f"COALESCE({raw_p[i]} < 0, TRUE) AND COALESCE({raw_n[i]} < 0, TRUE) AS done FROM {mx}"
            for i in range(cap + 1)))
        valid = self.add("gmvalid", f"SELECT s.* FROM {steps} s WHERE NOT EXISTS (SELECT 1 FROM {steps} q "
                                    f"WHERE q.step < s.step AND q.done)")
        sel = self.add("gmsel", f"SELECT v.step, u.* FROM {valid} v JOIN {used} u ON "
                                f"(u.cls = 0 AND {ratio.replace('n_correct', 'u.n_correct').replace('sup', 'u.sup')} > v.ep) OR "
                                f"(u.cls = 1 AND {ratio.replace('n_correct', 'u.n_correct').replace('sup', 'u.sup')} > v.en)")
        d, n = self.d, self.p.n_labels
        rows = self.fuzzified()
        md = match_sql([f"r.a{j}" for j in range(d)], [f"s.z{j}" for j in range(d)], n)
        if self.p.use_rw:
            md = f"{md} * r.rw"
        x = self.add("gmmd", f"SELECT r.step, s.rid, r.rule_id, r.cls, {md} AS md FROM {rows} s CROSS JOIN {sel} r")
        win = self.add("gmwin", f"SELECT step, rid, cls FROM (SELECT *, row_number() OVER (PARTITION BY step, rid "
                                f"ORDER BY md DESC, rule_id) AS rn FROM {x} WHERE md > 0) WHERE rn = 1")
        pred = self.add("gmpred", f"SELECT v.step, s.y, COALESCE(w.cls, m.maj) AS prediction FROM {valid} v "
                                  f"CROSS JOIN {rows} s CROSS JOIN {self.t('maj')} m LEFT JOIN {win} w "
                                  f"ON w.step = v.step AND w.rid = s.rid")
        cnt = self.add("gmcnt", "SELECT step, " + ", ".join(
            f"CAST(count_if(y = {a} AND prediction = {b}) AS DOUBLE) AS c{a}{b}" for a in (0, 1) for b in (0, 1))
            + f" FROM {pred} GROUP BY step")
        tpr0 = "(CASE WHEN c00 + c01 > 0 THEN c00 / (c00 + c01) END)"
        tpr1 = "(CASE WHEN c10 + c11 > 0 THEN c11 / (c10 + c11) END)"
        gm = self.add("gmgm", f"SELECT step, {round_at_sql(f'sqrt({tpr0} * {tpr1})', 5)} AS gm FROM {cnt}")
        stop = self.add("gmstop", f"SELECT v.step, CASE WHEN g0.gm > g1.gm THEN v.step - 1 ELSE v.step END AS pick "
                                  f"FROM {valid} v JOIN {gm} g1 ON g1.step = v.step JOIN {gm} g0 ON g0.step = v.step - 1 "
                                  f"WHERE g0.gm > g1.gm OR v.done")
        chosen = self.add("gmchosen", f"SELECT COALESCE((SELECT pick FROM {stop} ORDER BY step LIMIT 1), "
                                      f"(SELECT max(step) FROM {valid})) AS step")
        return self.add("gmfinal", f"SELECT * EXCLUDE (step) FROM {sel} WHERE step = "
                                   f"(SELECT step FROM {chosen})")

    def predictions(self, which: str = "all", method: str = "winning", shifted: bool = False,
                    name: str = "pred") -> str:
        """rid, [id], y, prediction for training rows or all rows."""
        rules = self.final()
        rows = self.fuzzified(which)
        maj = self.t("maj")
        if method == "winning":
            w = self.winners(rules, rows, f"{name}_win", shifted)
            pred = f"COALESCE(w.cls, m.maj)"
            join = f"LEFT JOIN {w} w ON s.rid = w.rid"
        else:
            w = self.class_sums(rules, rows, f"{name}_sum", shifted)
            pred = (f"CASE WHEN w.s0 - w.s1 > {dbl(1e-9)} THEN {dbl(0.0)} WHEN w.s1 - w.s0 > {dbl(1e-9)} "
                    f"THEN {dbl(1.0)} ELSE m.maj END")
            join = f"LEFT JOIN {w} w ON s.rid = w.rid"
        idc = "s.id, " if self.ds.has_id else ""
        return self.add(name, f"SELECT s.rid, {idc}s.y, {pred} AS prediction FROM {rows} s {join} "
                              f"CROSS JOIN {maj} m")

    def counts(self, pred: str) -> str:
        return self.add(f"{pred}_cnt", "SELECT " + ", ".join(
            f"count_if(y = {a} AND prediction = {b}) AS c{a}{b}" for a in (0, 1) for b in (0, 1))
            + f" FROM {pred}")

    @staticmethod
    def metrics_select(cnt: str) -> str:
        c = {k: f"CAST({k} AS DOUBLE)" for k in ("c00", "c01", "c10", "c11")}
        tpr0 = f"(CASE WHEN {c['c00']} + {c['c01']} > 0 THEN {c['c00']} / ({c['c00']} + {c['c01']}) END)"
        tpr1 = f"(CASE WHEN {c['c10']} + {c['c11']} > 0 THEN {c['c11']} / ({c['c10']} + {c['c11']}) END)"
        tot = f"({c['c00']} + {c['c01']} + {c['c10']} + {c['c11']})"
        acc = f"(CASE WHEN {tot} > 0 THEN ({c['c00']} + {c['c11']}) / {tot} END)"
        gm = f"pow({tpr0} * {tpr1}, {dbl(0.5)})"
        avg = f"(({tpr0} + {tpr1}) / {dbl(2.0)})"

        def r5(x):
            return round_at_sql(x, 5)
        return f"{r5(acc)} AS accuracy, {r5(gm)} AS gm, {r5(avg)} AS avg_accuracy FROM {cnt}"


def chain(key: str, **params) -> SqlChain:
    return SqlChain(DATASETS[key], RuleParams(**params))


class TreeChain(SqlChain):
    """A small tree from binned class counts: a group of tables per level."""

    BINS, DEPTH = 32, 3

    def binned(self, which: str) -> str:
        cols = ["rid"] + (["id"] if self.ds.has_id else []) + ["y", "1::BIGINT AS node"]
        cols += [f"least({self.BINS - 1}, greatest(0, CAST(floor(z{j} * {self.BINS}) AS INTEGER))) AS b{j}" for j in range(self.d)]
        whole = " AND ".join(f"z{j} IS NOT NULL" for j in range(self.d))
        return self.add(f"bins_{which}", f"SELECT {', '.join(cols)} FROM {self.fuzzified(which)} WHERE {whole}")

    def moved(self, rows: str, splits: str, name: str) -> str:
        own = "CASE s.j " + " ".join(f"WHEN {j} THEN r.b{j}" for j in range(self.d)) + " END"
        keep = ", ".join(["r.rid"] + (["r.id"] if self.ds.has_id else []) + ["r.y"] + [f"r.b{j}" for j in range(self.d)])
        return self.add(name, f"SELECT {keep}, CASE WHEN s.node IS NULL THEN r.node WHEN {own} <= s.b THEN 2 * r.node ELSE 2 * r.node + 1 END AS node "
                              f"FROM {rows} r LEFT JOIN {splits} s ON r.node = s.node")

    def tree(self) -> tuple[list[str], str]:
        """The split tables of all levels, and the class of each leaf."""
        rows, splits = self.binned("train"), []
        for level in range(self.DEPTH):
            long = " UNION ALL ".join(f"SELECT node, {j} AS j, b{j} AS b, y FROM {rows}" for j in range(self.d))
            hist = self.add(f"th{level}", f"SELECT node, j, b, count_if(y = 0) AS c0, count_if(y = 1) AS c1 FROM ({long}) GROUP BY node, j, b")
            w = "OVER (PARTITION BY node, j ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
            cum = self.add(f"tc{level}", f"SELECT node, j, b, CAST(sum(c0) {w} AS DOUBLE) AS l0, CAST(sum(c1) {w} AS DOUBLE) AS l1, "
                                         f"CAST(sum(c0) OVER (PARTITION BY node, j) AS DOUBLE) AS t0, CAST(sum(c1) OVER (PARTITION BY node, j) AS DOUBLE) AS t1 FROM {hist}")
            half = lambda a, b: f"({a} * {a} + {b} * {b}) / ({a} + {b})"
            score = f"({half('l0', 'l1')} + {half('(t0 - l0)', '(t1 - l1)')})"
            best = (f"SELECT node, j, b, row_number() OVER (PARTITION BY node ORDER BY {score} DESC, j, b) AS nth FROM {cum} "
                    f"WHERE t0 + t1 > l0 + l1 AND {score} > {half('t0', 't1')} + {dbl(1e-9)}")
            splits.append(self.add(f"ts{level}", f"SELECT node, j, b FROM ({best}) WHERE nth = 1"))
            rows = self.moved(rows, splits[-1], f"tr{level}")
        return splits, self.add("leaves", f"SELECT node, CASE WHEN count_if(y = 0) >= count_if(y = 1) THEN {dbl(0.0)} ELSE {dbl(1.0)} END AS cls "
                                          f"FROM {rows} GROUP BY node")

    def tree_predictions(self, which: str) -> str:
        splits, leaves = self.tree()
        rows = self.binned(which)
        for level, s in enumerate(splits):
            rows = self.moved(rows, s, f"ta_{which}{level}")
        return self.add(f"tp_{which}", f"SELECT r.*, l.cls AS prediction FROM {rows} r JOIN {leaves} l ON r.node = l.node")


def entropy_sql(a: str, b: str) -> str:
    n = f"CAST(({a}) + ({b}) AS DOUBLE)"

    def term(c):
        p = f"(CAST({c} AS DOUBLE) / {n})"
        return f"(CASE WHEN {c} > 0 THEN -{p} * log2({p}) ELSE {dbl(0.0)} END)"
    return f"({term(a)} + {term(b)})"


def information_sql(cnt: str, keys: str) -> str:
    """Mutual information of a and b per ``keys`` from counts n."""
    tot = f"CAST(sum(n) OVER (PARTITION BY {keys}) AS DOUBLE)"
    pab = f"(CAST(n AS DOUBLE) / {tot})"
    pa = f"(CAST(sum(n) OVER (PARTITION BY {keys}, a) AS DOUBLE) / {tot})"
    pb = f"(CAST(sum(n) OVER (PARTITION BY {keys}, b) AS DOUBLE) / {tot})"
    return (f"SELECT {keys}, sum(t) AS mi FROM (SELECT {keys}, {pab} * log2({pab} / ({pa} * {pb})) AS t "
            f"FROM {cnt}) GROUP BY {keys}")


class SelectionChain(SqlChain):
    """The chain after feature selection: MDLP cuts at every level (all
    candidate cuts of all intervals are tried), bins, mRMR picks, and rules on the
    picked features alone.  A feature that is not picked has label 0 in every
    row and takes part in no subset."""

    def __init__(self, *args, **kw):
        super().__init__(*args, **kw)
        self._all = False

    def every(self) -> str:
        self._all, before = True, self._all
        out = super().fuzzified("train")
        self._all = before
        return out

    def cuts(self) -> str:
        most = self.p.mdlp_max_bins
        long = self.add("zlong", " UNION ALL ".join(f"SELECT rid, {j} AS j, z{j} AS v, y FROM {self.every()}" for j in range(self.d)))
        hist = self.add("hist", f"SELECT j, v, count_if(y = 0) AS c0, count_if(y = 1) AS c1 FROM {long} GROUP BY j, v")
        w = "OVER (PARTITION BY j ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        cum = self.add("cum", f"SELECT j, v, CAST(sum(c0) {w} AS BIGINT) AS s0, CAST(sum(c1) {w} AS BIGINT) AS s1, "
                              f"lead(v) OVER (PARTITION BY j ORDER BY v) AS nv FROM {hist}")
        last = self.add("iv0", "SELECT j, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi, 0::BIGINT AS b0, 0::BIGINT AS b1, "
                               f"CAST(sum(c0) AS BIGINT) AS e0, CAST(sum(c1) AS BIGINT) AS e1, 0::BIGINT AS had FROM {hist} GROUP BY j")
        found = []
        for level in range(most - 1):  # every level that goes on adds a cut
            x = self.add(f"try{level}", f"SELECT i.*, c.v, c.nv, c.s0 - i.b0 AS l0, c.s1 - i.b1 AS l1, i.e0 - c.s0 AS r0, i.e1 - c.s1 AS r1, "
                                        f"i.e0 - i.b0 AS t0, i.e1 - i.b1 AS t1 FROM {cum} c JOIN {last} i ON c.j = i.j "
                                        f"WHERE c.nv IS NOT NULL AND (i.lo IS NULL OR c.v > i.lo) AND (i.hi IS NULL OR c.v < i.hi)")
            n = "CAST(t0 + t1 AS DOUBLE)"
            hl, hr, ht = entropy_sql("l0", "l1"), entropy_sql("r0", "r1"), entropy_sql("t0", "t1")
            e = f"(((l0 + l1) * {hl} + (r0 + r1) * {hr}) / {n})"
            best = self.add(f"best{level}", f"SELECT *, {ht} - e AS gain FROM (SELECT *, row_number() OVER (PARTITION BY j, lo ORDER BY e, v) AS nth "
                                            f"FROM (SELECT *, {e} AS e FROM {x})) WHERE nth = 1")
            k, k1, k2 = (f"(CAST({a}0 > 0 AS INTEGER) + CAST({a}1 > 0 AS INTEGER))" for a in "tlr")
            delta = f"(log2(pow({dbl(3.0)}, {k}) - 2) - ({k} * {ht} - {k1} * {hl} - {k2} * {hr}))"
            kept = self.add(f"kept{level}", f"SELECT *, count(*) OVER (PARTITION BY j) AS more FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY gain DESC, lo) AS place "
                                            f"FROM {best} WHERE t0 + t1 >= 2 AND gain > (log2({n} - 1) + {delta}) / {n}) WHERE had + place <= {most - 1}")
            found.append(f"SELECT j, (v + nv) / {dbl(2.0)} AS cut FROM {kept}")
            last = self.add(f"iv{level + 1}", f"SELECT j, lo, v AS hi, b0, b1, b0 + l0 AS e0, b1 + l1 AS e1, had + more AS had FROM {kept} UNION ALL "
                                              f"SELECT j, v AS lo, hi, b0 + l0 AS b0, b1 + l1 AS b1, e0, e1, had + more AS had FROM {kept}")
        return self.add("cuts", " UNION ALL ".join(found))

    def picks(self) -> str:
        import math
        cuts = self.cuts()
        b = self.add("binned", f"SELECT l.rid, l.j, count(c.cut) AS a, any_value(l.y) AS y FROM {self.t('zlong')} l "
                               f"LEFT JOIN {cuts} c ON c.j = l.j AND l.v > c.cut GROUP BY l.rid, l.j")
        rel = self.add("selrel", information_sql(self.add("selcnt", f"SELECT j, a, y AS b, count(*) AS n FROM {b} GROUP BY j, a, y"), "j"))
        pairs = self.add("selpairs", f"SELECT x.j, p.j AS k, x.a, p.a AS b, count(*) AS n FROM {b} x JOIN {b} p ON x.rid = p.rid "
                                     "WHERE x.j <> p.j GROUP BY x.j, p.j, x.a, p.a")
        return mrmr_picks(self, rel, self.add("selmi", information_sql(pairs, "j, k")), max(1, math.ceil(self.d * self.p.fs)))

    def flags(self) -> str:
        return self.add("flags", "SELECT " + ", ".join(f"bool_or(j = {j}) AS k{j}" for j in range(self.d)) + f" FROM {self.picks()}")

    def fuzzified(self, which: str = "train") -> str:
        base = super().fuzzified(which)
        if self._all:
            return base
        self._all = True
        flags = self.flags()
        self._all = False
        cols = ["f.rid"] + (["f.id"] if self.ds.has_id else []) + ["f.y"]
        cols += [f"CASE WHEN s.k{j} THEN f.z{j} ELSE {dbl(0.5)} END AS z{j}" for j in range(self.d)]
        cols += [f"CASE WHEN s.k{j} THEN f.l{j} ELSE 0 END AS l{j}" for j in range(self.d)]
        return self.add(f"chosen_{which}", f"SELECT {', '.join(cols)} FROM {base} f CROSS JOIN {flags} s")

    def masks(self, table: str) -> str:
        only = " AND ".join(f"(m.m{j} = 0 OR s.k{j})" for j in range(self.d))
        return self.add("chosen_masks", f"SELECT m.* FROM {table} m CROSS JOIN {self.flags()} s WHERE {only}")

    def ant_key(self, alias: str = "") -> str:
        parts = [f"CASE WHEN (SELECT k{j} FROM {self.flags()}) THEN CAST({a} AS VARCHAR) END" for j, a in enumerate(self.ants(alias))]
        return f"concat_ws('|', {', '.join(parts)})"


def mrmr_picks(c: SqlChain, rel: str, pairs: str, k: int) -> str:
    """(rank, j) of the first k features by relevance less mean redundancy."""
    names = []
    for i in range(k):
        joins = " ".join(f"JOIN {pairs} m{t} ON m{t}.j = r.j AND m{t}.k = (SELECT j FROM {p})" for t, p in enumerate(names))
        red = f" - ({dbl(0.0)} + {' + '.join(f'm{t}.mi' for t in range(i))}) / {dbl(float(i))}" if i else ""
        names.append(c.add(f"pick{i + 1}", f"SELECT r.j FROM {rel} r {joins} ORDER BY r.mi{red} DESC, r.j LIMIT 1"))
    return c.add("picks", " UNION ALL ".join(f"SELECT CAST({i + 1} AS INTEGER) AS rank, j FROM {p}" for i, p in enumerate(names)))
