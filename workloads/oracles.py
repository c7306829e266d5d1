"""SQL twins of ``workloads.registry``, written for DuckDB over the same tables."""

from __future__ import annotations

from itertools import product

from workloads.registry import ALPHA0, ALS_TOLERANCE, B_START, C_START, FIT_TOLERANCE, SIGMA


def num(value: float) -> str:
    """DuckDB reads plain decimals as DECIMAL, so every constant is cast."""
    return f"({float(value)!r})::DOUBLE"


A0 = num(ALPHA0)
LINES = "SELECT l_orderkey AS doc_id, l_partkey AS word_id, sum(l_quantity)::DOUBLE AS cnt FROM lineitem GROUP BY 1, 2"
N_ORDERS = "(SELECT count(*) FROM orders)::DOUBLE"
N_TEXTS = "(SELECT count(*) FROM documents)::DOUBLE"


def ctes(parts: dict[str, str], final: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in parts.items()) + "\n" + final


def rnd(expr: str, digits: int, name: str) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def wave(index: str, j: int) -> str:
    return f"sin(({index} + 1) * {num(1.3 + 0.7 * j)})"


def cols(prefix: str, width: int, digits: int | None = None) -> str:
    names = [f"{prefix}{j}" for j in range(width)]
    return ", ".join(rnd(n, digits, n) for n in names) if digits else ", ".join(names)


def part_model(width: int, prefix: str = "o", key: str = "word_id") -> str:
    waves = ", ".join(f"{wave('p_partkey', j)} AS {prefix}{j}" for j in range(width))
    return f"SELECT p_partkey AS {key}, {waves} FROM part"


def text_corpus(width: int) -> dict[str, str]:
    """Words of the documents, numbered in byte order, and the wave matrix over them."""
    waves = ", ".join(f"{wave('word_id', j)} AS o{j}" for j in range(width))
    return {
        "words": "SELECT doc_id, lower(unnest(regexp_extract_all(text, '\\p{L}+'))) AS word FROM documents",
        "vocabulary": "SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_id FROM (SELECT DISTINCT word FROM words)",
        "tokens": "SELECT doc_id, word_id, count(*)::DOUBLE AS cnt FROM words JOIN vocabulary USING (word) GROUP BY 1, 2",
        "model": f"SELECT word_id, {waves} FROM vocabulary",
    }


def projection(width: int, tokens: str = "tokens", model: str = "model", divisors: list[str] | None = None) -> str:
    sums = ", ".join(
        f"sum(cnt * o{j}{f' / {divisors[j]}' if divisors else ''}) AS x{j}" for j in range(width)
    )
    return f"SELECT doc_id, sum(cnt) AS len, {sums} FROM {tokens} JOIN {model} USING (word_id) GROUP BY doc_id"


def sketch(width: int, tokens: str = "tokens", model: str = "model") -> dict[str, str]:
    sums = ", ".join(f"sum(cnt / (len * (len - 1)) * (x{j} - o{j})) AS y{j}" for j in range(width))
    return {
        f"{model}_docs": projection(width, tokens, model),
        f"{model}_sketch": f"""SELECT t.word_id, sum(cnt / len) AS mu_sum, {sums} FROM {tokens} t
            JOIN {model}_docs USING (doc_id) JOIN {model} m ON m.word_id = t.word_id WHERE len >= 2 GROUP BY t.word_id""",
    }


def corrected(width: int, n: str, tokens: str = "tokens", model: str = "model") -> dict[str, str]:
    inner = ", ".join(f"sum(mu_sum / {n} * o{j}) AS s{j}" for j in range(width))
    outer = ", ".join(f"(1 + {A0}) / {n} * y{j} - {A0} * mu_sum / {n} * s{j} AS y{j}" for j in range(width))
    return {
        **sketch(width, tokens, model),
        f"{model}_shift": f"SELECT {inner} FROM {model}_sketch JOIN {model} USING (word_id)",
        f"{model}_y": f"SELECT word_id, mu_sum / {n} AS mu, {outer} FROM {model}_sketch, {model}_shift",
    }


def gram2(source: str, p: str = "y") -> str:
    return f"SELECT sum({p}0 * {p}0) AS g00, sum({p}0 * {p}1) AS g01, sum({p}1 * {p}1) AS g11 FROM {source}"


def orthonormal2(source: str, prefix: str, out: str, key: str = "word_id", p: str = "y") -> dict[str, str]:
    """Gram-Schmidt on two columns."""
    return {
        f"{prefix}_g": gram2(source, p),
        f"{prefix}": f"""SELECT {key}, {p}0 / sqrt(g00) AS {out}0,
            ({p}1 - g01 / g00 * {p}0) / sqrt(g11 - g01 * g01 / g00) AS {out}1 FROM {source}, {prefix}_g""",
    }


def spectral2(source: str, prefix: str) -> dict[str, str]:
    """Closed-form eigenpairs of the 2x2 Gram matrix, scaled columns, sign by word 0."""
    return {
        f"{prefix}_g": gram2(source),
        f"{prefix}_e": f"""SELECT *, (g00 + g11 + sqrt((g00 - g11) * (g00 - g11) + 4 * g01 * g01)) / 2 AS e0,
            (g00 + g11 - sqrt((g00 - g11) * (g00 - g11) + 4 * g01 * g01)) / 2 AS e1 FROM {prefix}_g""",
        f"{prefix}_v": f"""SELECT sqrt(sqrt(e0)) AS s0, sqrt(sqrt(e1)) AS s1, g01 / h AS a, (e0 - g00) / h AS b
            FROM (SELECT *, sqrt(g01 * g01 + (e0 - g00) * (e0 - g00)) AS h FROM {prefix}_e)""",
        f"{prefix}_raw": f"""SELECT word_id, s0, s1, (y0 * a + y1 * b) / (s0 + 1e-12::DOUBLE) AS r0,
            (y1 * a - y0 * b) / (s1 + 1e-12::DOUBLE) AS r1 FROM {source}, {prefix}_v""",
        f"{prefix}": f"""SELECT word_id, s0, s1, r0 * (SELECT sign(r0) FROM {prefix}_raw WHERE word_id = 0) AS o0,
            r1 * (SELECT sign(r1) FROM {prefix}_raw WHERE word_id = 0) AS o1 FROM {prefix}_raw""",
    }


def range2(n: str, tokens: str = "tokens", start: str = "model") -> dict[str, str]:
    """Both passes of the range finder, two columns."""
    return {
        **corrected(2, n, tokens, start),
        **orthonormal2(f"{start}_y", "basis", "o"),
        **corrected(2, n, tokens, "basis"),
        **spectral2("basis_y", "factor"),
    }


def dirichlet_factors(length: str = "len") -> tuple[str, str]:
    s2 = f"{A0} * ({A0} + 1) / (2 * {length} * ({length} - 1))"
    s3 = f"({A0} + 1) * ({A0} + 2) / (2 * {length} * ({length} - 1) * ({length} - 2))"
    return s2, s3


def tensor_cells(k: int, docs: str, m1: str) -> str:
    """The mean over documents of the third-moment terms, cell by cell, from their definition.

    ``docs`` has (len, x0..) and ``m1`` one row (m0..).
    """
    s2, s3 = dirichlet_factors()
    selects = []
    for i, j, m in product(range(k), repeat=3):
        terms = [f"s3 * x{i} * x{j} * x{m}", f"- s2 * (m{i} * x{j} * x{m} + x{i} * m{j} * x{m} + x{i} * x{j} * m{m})"]
        if i == j:
            terms.append(f"- s3 * x{i} * x{m} + s2 * x{i} * m{m}")
        if i == m:
            terms.append(f"- s3 * x{i} * x{j} + s2 * x{i} * m{j}")
        if j == m:
            terms.append(f"- s3 * x{i} * x{j} + s2 * m{i} * x{j}")
        if i == j == m:
            terms.append(f"+ {2 * k} * s3 * x{i}")
        cell = f"avg({' '.join(terms)}) + {A0} * {A0} * any_value(m{i} * m{j} * m{m})"
        selects.append(f"SELECT {i} AS i, {j} AS j, {m} AS l, {cell} AS val FROM weighted")
    weighted = f"SELECT *, {s2} AS s2, {s3} AS s3 FROM {docs}, {m1} WHERE len >= 3"
    return f"WITH weighted AS ({weighted}) " + " UNION ALL ".join(selects)


def first_moments(k: int, docs: str, n: str) -> str:
    return "SELECT " + ", ".join(f"sum(CASE WHEN len <> 0 THEN x{j} / len ELSE 0 END) / {n} AS m{j}" for j in range(k)) + f" FROM {docs}"


MODES = "ijl"
# Iterations that the twins write out; the decompositions stop before.
ALS_ITERATIONS, FIT_ITERATIONS = 8, 16


def factor_pair(mode: int) -> tuple[int, int]:
    a, b = [m for m in range(3) if m != mode]
    return a, b


def mttkrp(cells: str, factors: list[str], mode: int) -> str:
    a, b = factor_pair(mode)
    return f"""SELECT {MODES[mode]} AS idx, sum(val * p.f0 * q.f0) AS f0, sum(val * p.f1 * q.f1) AS f1 FROM {cells} t
        JOIN {factors[a]} p ON p.idx = t.{MODES[a]} JOIN {factors[b]} q ON q.idx = t.{MODES[b]} GROUP BY 1"""


def als_step(cells: str, factors: list[str], mode: int, out: str, rho: float = 0.0) -> dict[str, str]:
    """Unnormalised least-squares update of one factor of rank 2."""
    a, b = factor_pair(mode)
    return {
        f"{out}_x": mttkrp(cells, factors, mode),
        f"{out}_h": f"""SELECT p.g00 * q.g00 AS h00, p.g01 * q.g01 AS h01, p.g11 * q.g11 AS h11
            FROM ({gram2(factors[a], 'f')}) p, ({gram2(factors[b], 'f')}) q""",
        f"{out}_r": f"""SELECT h00 + r AS h00, h01, h11 + r AS h11 FROM
            (SELECT *, {num(rho)} * (h00 * h00 + 2 * h01 * h01 + h11 * h11) / 2 AS r FROM {out}_h)""",
        out: f"""SELECT idx, (f0 * h11 - f1 * h01) / (h00 * h11 - h01 * h01) AS f0,
            (f1 * h00 - f0 * h01) / (h00 * h11 - h01 * h01) AS f1 FROM {out}_x, {out}_r""",
    }


def unit(source: str, out: str) -> dict[str, str]:
    return {
        f"{out}_n": f"SELECT sqrt(sum(f0 * f0)) AS n0, sqrt(sum(f1 * f1)) AS n1 FROM {source}",
        out: f"SELECT idx, f0 / n0 AS f0, f1 / n1 AS f1 FROM {source}, {out}_n",
    }


def als_until(cells: str, b: str, c: str, tolerance: float, most: int) -> dict[str, str]:
    """Iterations until A changes by less than the tolerance, written out up to ``most`` of them.

    ``fa_end``, ``fb_end``, ``fc_end`` and ``norms_end`` are the factors and weights of the iteration that stops.
    """
    out: dict[str, str] = {}
    for n in range(1, most + 1):
        out |= {
            **als_step(cells, ["", b, c], 0, f"a{n}"),
            **unit(f"a{n}", f"ua{n}"),
            **als_step(cells, [f"ua{n}", "", c], 1, f"b{n}"),
            **unit(f"b{n}", f"ub{n}"),
            **orthonormal2(f"ub{n}", f"qb{n}", "f", "idx", "f"),
            **als_step(cells, [f"ua{n}", f"qb{n}", ""], 2, f"c{n}"),
            **unit(f"c{n}", f"uc{n}"),
            **orthonormal2(f"uc{n}", f"qc{n}", "f", "idx", "f"),
        }
        b, c = f"qb{n}", f"qc{n}"
    changes = " UNION ALL ".join(
        f"""SELECT {n} AS n, sqrt(sum((p.f0 - q.f0) ** 2 + (p.f1 - q.f1) ** 2) / sum(p.f0 * p.f0 + p.f1 * p.f1)) AS change
        FROM ua{n} p JOIN ua{n - 1} q USING (idx)"""
        for n in range(2, most + 1)
    )
    out["stop"] = f"SELECT min(n) AS n FROM ({changes}) WHERE change < {num(tolerance)}"
    for name, source in (("fa_end", "ua{}"), ("fb_end", "qb{}"), ("fc_end", "qc{}"), ("norms_end", "ua{}_n")):
        rows = " UNION ALL ".join(f"SELECT *, {n} AS n FROM {source.format(n)}" for n in range(2, most + 1))
        out[name] = f"SELECT * EXCLUDE (n) FROM ({rows}) WHERE n = (SELECT n FROM stop)"
    return out


def values_factor(rows: list[tuple]) -> str:
    body = ", ".join(f"({i}, {num(x)}, {num(y)})" for i, x, y in rows)
    return f"SELECT * FROM (VALUES {body}) v(idx, f0, f1)"


def simplex(source: str, group: str, id: str, value: str, out: str) -> dict[str, str]:
    """Sort-based projection of each group."""
    order = f"PARTITION BY {group} ORDER BY {value} DESC, {id}"
    return {
        f"{out}_s": f"""SELECT *, sum({value}) OVER ({order} ROWS UNBOUNDED PRECEDING) AS c, row_number() OVER ({order}) AS n FROM {source}""",
        f"{out}_t": f"SELECT {group}, max_by((c - 1) / n, n) AS theta FROM {out}_s WHERE {value} > (c - 1) / n GROUP BY {group}",
        out: f"SELECT s.* EXCLUDE ({value}), greatest({value} - theta, 0) AS {value} FROM {source} s JOIN {out}_t USING ({group})",
    }


def recovered(source: str, topics: int) -> dict[str, str]:
    """Project f and -f of each topic, keep the closer one. ``source`` has (word_id, f0..)."""
    cells = " UNION ALL ".join(
        f"SELECT word_id, {t} AS topic, {s} AS side, {t} * 2 + {(s + 1) // 2} AS grp, {s} * f{t} AS v, {s} * f{t} AS f FROM {source}"
        for t in range(topics)
        for s in (1, -1)
    )
    return {
        "signed": cells,
        **simplex("signed", "grp", "word_id", "v", "projected"),
        "errors": "SELECT topic, side, sqrt(sum((v - f) * (v - f))) AS err FROM projected GROUP BY 1, 2",
        "sides": """SELECT p.topic, CASE WHEN p.err < m.err THEN 1 ELSE -1 END AS side
            FROM errors p JOIN errors m ON p.topic = m.topic AND p.side = 1 AND m.side = -1""",
        "topics": "SELECT word_id, topic, v AS prob FROM projected JOIN sides USING (topic, side)",
    }


SEGMENTS = "SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS i FROM (SELECT DISTINCT c_mktsegment FROM customer)"
SALES = """SELECT i, replace(p_brand, 'Brand#', '')::INT - 1 AS j, ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::INT AS l,
    sum(l_quantity) AS val FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN segments USING (c_mktsegment) GROUP BY 1, 2, 3"""


def sales_factors(rank: int = 2) -> dict[str, str]:
    out = {"segments": SEGMENTS, "sales": SALES}
    for name, mode in zip(("fa", "fb", "fc"), MODES):
        waves = ", ".join(f"{wave('idx', r)} AS f{r}" for r in range(rank))
        out[name] = f"SELECT idx, {waves} FROM (SELECT DISTINCT {mode} AS idx FROM sales)"
    return out


def vectors(width: int) -> str:
    size, price = f"p_size / {num(50)}", f"p_retailprice / {num(1000)}"
    columns = [size, price, f"{wave('p_partkey', 0)} + {size}", f"{wave('p_partkey', 1)} + {price}"][:width]
    return "SELECT p_partkey AS word_id, " + ", ".join(f"{c} AS y{j}" for j, c in enumerate(columns)) + " FROM part"


def gaussian(width: int, seed: int) -> str:
    drawn, values = [], []
    for pair in range((width + 1) // 2):
        digest = f"md5(concat_ws(':', '{seed}', p_partkey, '{pair}'))"
        for name, at in (("u", 1), ("v", 14)):
            drawn.append(f"('0x' || substr({digest}, {at}, 13))::BIGINT::DOUBLE AS {name}{pair}")
        radius = f"sqrt(-2 * ln((u{pair} + 1) / {num(1 << 52)}))"
        for fn in ("cos", "sin"):
            values.append(f"{radius} * {fn}(v{pair} * (2 * pi() / {num(1 << 52)}))")
    picked = ", ".join(rnd(v, 8, f"o{j}") for j, v in enumerate(values[:width]))
    return f"SELECT word_id, {picked} FROM (SELECT p_partkey AS word_id, {', '.join(drawn)} FROM part)"


def third_sums(k: int) -> str:
    s2, s3 = dirichlet_factors()
    selects = ["SELECT 'n3' AS part, -1 AS i, -1 AS j, -1 AS l, count(*)::DOUBLE AS val FROM w"]
    for i in range(k):
        selects.append(f"SELECT 'x1', {i}, -1, -1, sum(x{i} / len) FROM docs WHERE len <> 0")
        selects += [f"SELECT '{p}', {i}, -1, -1, sum({s} * x{i}) FROM w" for p, s in (("g1", "s3"), ("h1", "s2"))]
        for j in range(i, k):
            selects += [f"SELECT '{p}', {i}, {j}, -1, sum({s} * x{i} * x{j}) FROM w" for p, s in (("g2", "s3"), ("p2", "s2"))]
            selects += [f"SELECT 'c3', {i}, {j}, {m}, sum(s3 * x{i} * x{j} * x{m}) FROM w" for m in range(j, k)]
    return f"SELECT *, {s2} AS s2, {s3} AS s3 FROM docs WHERE len >= 3", " UNION ALL ".join(selects)


def word_corrected_cells(n: str) -> tuple[dict[str, str], str]:
    """The two-topic third moment with repeated words removed in word space, from its definition.

    Takes ``tokens`` and the whitener ``w``. A document's cell is s3 times the sum over distinct
    token positions plus the Dirichlet terms.
    """
    s2, s3 = dirichlet_factors()
    known = "SELECT doc_id, cnt, " + ", ".join(f"coalesce(o{j}, 0) AS o{j}" for j in range(2)) + " FROM tokens LEFT JOIN w USING (word_id)"
    parts = {
        "known": known,
        "docs": "SELECT doc_id, sum(cnt) AS len, " + ", ".join(f"sum(cnt * o{j}) AS x{j}" for j in range(2)) + " FROM known GROUP BY doc_id",
        "m1": first_moments(2, "docs", n),
        "own": "SELECT doc_id, "
        + ", ".join(f"sum(cnt * o{a} * o{b}) AS b{a}{b}" for a in range(2) for b in range(2))
        + ", "
        + ", ".join(f"sum(cnt * o{a} * o{b} * o{c}) AS c{a}{b}{c}" for a, b, c in product(range(2), repeat=3))
        + " FROM known GROUP BY doc_id",
        "weighted": f"SELECT *, {s2} AS s2, {s3} AS s3 FROM docs JOIN own USING (doc_id), m1 WHERE len >= 3",
    }
    selects = []
    for i, j, m in product(range(2), repeat=3):
        triples = f"x{i} * x{j} * x{m} - b{i}{j} * x{m} - b{i}{m} * x{j} - b{j}{m} * x{i} + 2 * c{i}{j}{m}"
        pairs = " + ".join(
            f"m{a} * (x{b} * x{c} - b{b}{c})" for a, b, c in ((i, j, m), (j, i, m), (m, i, j))
        )
        cell = f"avg(s3 * ({triples}) - s2 * ({pairs})) + {A0} * {A0} * any_value(m{i} * m{j} * m{m})"
        selects.append(f"SELECT {i} AS i, {j} AS j, {m} AS l, {cell} AS val FROM weighted")
    return parts, " UNION ALL ".join(selects)


def word_corrected_tensor() -> str:
    sigma = [1.25, 0.5]
    parts, cells = word_corrected_cells(N_ORDERS)
    whitener = "SELECT word_id, " + ", ".join(f"o{j} / {num(s * s)} AS o{j}" for j, s in enumerate(sigma)) + " FROM model"
    return ctes(
        {"tokens": LINES, "model": part_model(2), "w": whitener, **parts, "cells": cells}, f"SELECT i, j, l, {rnd('val', 10, 'val')} FROM cells"
    )


def fit_two_topics(whitened: bool) -> str:
    """The whole job for two topics, the decomposition written out until it converges."""
    if whitened:
        parts, cells = word_corrected_cells(N_TEXTS)
        middle = {
            "w": "SELECT word_id, " + ", ".join(f"o{j} / (s{j} * s{j}) AS o{j}" for j in range(2)) + " FROM factor",
            **parts,
            "cells": cells,
        }
    else:
        divisors = ["(s0 * (1 + 1e-6::DOUBLE))", "(s1 + 1e-6::DOUBLE * s0)"]
        middle = {
            "w": "SELECT word_id, o0, o1 FROM factor",
            "docs": "SELECT doc_id, sum(cnt) AS len, "
            + ", ".join(f"sum(cnt * coalesce(o{j} / {s}, 0)) AS x{j}" for j, s in enumerate(divisors))
            + " FROM tokens LEFT JOIN factor USING (word_id) GROUP BY doc_id",
            "m1": first_moments(2, "docs", N_TEXTS),
            "cells": tensor_cells(2, "docs", "m1"),
        }
    parts = {
        **text_corpus(2),
        **range2(N_TEXTS),
        **middle,
        "b0": values_factor(B_START),
        "c0": values_factor(C_START),
        **als_until("cells", "b0", "c0", FIT_TOLERANCE, FIT_ITERATIONS),
        "votes": "SELECT "
        + ", ".join(
            f"(SELECT sign(f{r}) FROM fa_end WHERE idx = 0) AS a{r}, (SELECT sign(f{r}) FROM fb_end WHERE idx = 0) AS b{r}, (SELECT sign(f{r}) FROM fc_end WHERE idx = 0) AS c{r}"
            for r in range(2)
        ),
        "voted": "SELECT a.idx, "
        + ", ".join(f"CASE WHEN a{r} = c{r} AND a{r} <> b{r} THEN b.f{r} WHEN a{r} = b{r} AND a{r} <> c{r} THEN c.f{r} ELSE a.f{r} END AS f{r}" for r in range(2))
        + " FROM fa_end a JOIN fb_end b USING (idx) JOIN fc_end c USING (idx), votes",
        "og": gram2("w", "o"),
        "small": """SELECT max(CASE WHEN idx = 0 THEN f0 END) * n0 AS a00, max(CASE WHEN idx = 0 THEN f1 END) * n1 AS a01,
            max(CASE WHEN idx = 1 THEN f0 END) * n0 AS a10, max(CASE WHEN idx = 1 THEN f1 END) * n1 AS a11
            FROM voted, norms_end GROUP BY n0, n1""",
        "found": """SELECT word_id, (o0 * (g11 * a00 - g01 * a10) + o1 * (g00 * a10 - g01 * a00)) / (g00 * g11 - g01 * g01) AS f0,
            (o0 * (g11 * a01 - g01 * a11) + o1 * (g00 * a11 - g01 * a01)) / (g00 * g11 - g01 * g01) AS f1 FROM w, og, small""",
        "factors": "SELECT word_id, coalesce(f0, 0) AS f0, coalesce(f1, 0) AS f1 FROM vocabulary LEFT JOIN found USING (word_id)",
        **recovered("factors", 2),
        "prior": """SELECT t.topic, power(CASE WHEN t.topic = 0 THEN n0 ELSE n1 END, -2) / (power(n0, -2) + power(n1, -2)) AS alpha
            FROM norms_end, (VALUES (0), (1)) t(topic)""",
    }
    return ctes(parts, f"SELECT word_id, topic, {rnd('prob', 8, 'prob')}, {rnd(f'alpha * {A0}', 6, 'alpha')} FROM topics JOIN prior USING (topic)")


def admm(rounds: int) -> str:
    """The ADMM rounds written out, each with its own simplex projection."""
    parts = {"s0": "SELECT event_type, event_id, value / 1000 AS v, 0.0::DOUBLE AS z, 0.0::DOUBLE AS u FROM events"}
    for r in range(rounds):
        parts[f"m{r}"] = f"SELECT event_type, event_id, v, u, (v + z - u) / 2 AS m, (v + z - u) / 2 + u AS w FROM s{r}"
        parts.update(simplex(f"m{r}", "event_type", "event_id", "w", f"p{r}"))
        parts[f"s{r + 1}"] = f"SELECT event_type, event_id, v, w AS z, u + m - w AS u FROM p{r}"
    return ctes(parts, f"SELECT event_type, event_id, {rnd('z', 10, 'value')} FROM s{rounds}")


def build() -> dict[str, str]:
    bags = {"tokens": LINES}
    lengths = {"lens": "SELECT doc_id, sum(cnt) AS len FROM tokens GROUP BY doc_id"}
    stats = {
        **bags,
        "stats": "SELECT o_orderkey AS doc_id, coalesce(sum(cnt), 0) AS len FROM orders LEFT JOIN tokens ON doc_id = o_orderkey GROUP BY 1",
    }
    s2, s3 = dirichlet_factors()
    ridged = [num(s + 1e-6 * SIGMA[0]) for s in SIGMA]
    scaled = {**bags, "model": part_model(3), "docs": projection(3, divisors=ridged)}
    w_sql, sums_sql = third_sums(3)
    sales = sales_factors()
    factor_names = ["fa", "fb", "fc"]
    text = text_corpus(2)
    events = {"ev": "SELECT event_type, event_id, value / 1000 AS value FROM events"}

    out = {
        "bow_text_scan": ctes(bags, "SELECT o_orderkey AS doc_id, word_id, cnt FROM orders LEFT JOIN tokens ON doc_id = o_orderkey"),
        "dense_rows_scan": """SELECT p_partkey AS row_id, unnest([0, 1])::BIGINT AS at, unnest([p_size::DOUBLE, p_retailprice]) AS val FROM part
            UNION ALL SELECT p_partkey, 2, p_size * 2 FROM part WHERE p_size > 25""",
        "saved_matrix_scan": "SELECT p_partkey AS row_id, p_size::DOUBLE AS v0, p_retailprice AS v1, p_partkey::DOUBLE AS v2 FROM part",
        "matrix_text_sink": """SELECT l_suppkey || chr(9) || printf('%.6f', sum(l_quantity)) || chr(9) || printf('%.6f', count(*)::DOUBLE)
            || chr(9) || printf('%.6f', min(l_quantity) / 4) AS line FROM lineitem GROUP BY l_suppkey""",
        "doc_terms": LINES,
        "min_length_filter": ctes({**bags, **lengths}, "SELECT doc_id, word_id, cnt FROM tokens JOIN lens USING (doc_id) WHERE len >= 3"),
        "term_frequency": ctes({**bags, **lengths}, f"SELECT doc_id, word_id, {rnd('cnt / len', 12, 'tf')} FROM tokens JOIN lens USING (doc_id)"),
        "doc_stats": ctes(stats, "SELECT doc_id, len FROM stats"),
        "corpus_counts": ctes(stats, "SELECT count(*) AS n_docs, count(*) FILTER (len >= 2) AS n_pair, count(*) FILTER (len >= 3) AS n_triple FROM stats"),
        "moment_weights": ctes(
            stats,
            f"""SELECT doc_id, len, CASE WHEN len >= 2 THEN round(1 / (len * (len - 1)), 12) + 0.0 END AS pair,
            CASE WHEN len >= 3 THEN round({s2}, 12) + 0.0 END AS s2, CASE WHEN len >= 3 THEN round({s3}, 12) + 0.0 END AS s3 FROM stats""",
        ),
        "model_lookup": ctes({**bags, "model": part_model(3)}, f"SELECT doc_id, word_id, cnt, {cols('o', 3, 10)} FROM tokens JOIN model USING (word_id)"),
        "pair_moment_sketch": ctes(
            {**bags, "model": part_model(4), **sketch(4)}, f"SELECT word_id, {rnd('mu_sum', 7, 'mu_sum')}, {cols('y', 4, 7)} FROM model_sketch"
        ),
        "mean_frequency": ctes(
            {**bags, **lengths}, f"SELECT word_id, {rnd(f'sum(cnt / len) / {N_ORDERS}', 12, 'mu')} FROM tokens JOIN lens USING (doc_id) WHERE len >= 2 GROUP BY 1"
        ),
        "raw_mean_document": ctes(
            {**bags, **lengths}, f"SELECT word_id, {rnd(f'sum(cnt / len) / {N_ORDERS}', 12, 'mu')} FROM tokens JOIN lens USING (doc_id) GROUP BY 1"
        ),
        "doc_projection": ctes({**bags, "model": part_model(4), "docs": projection(4)}, f"SELECT doc_id, len, {cols('x', 4, 7)} FROM docs"),
        "scaled_projection": ctes(scaled, f"SELECT doc_id, len, {cols('x', 3, 7)} FROM docs"),
        "corrected_pair_moment": ctes(
            {**bags, "model": part_model(4), **corrected(4, N_ORDERS)}, f"SELECT word_id, {rnd('mu', 12, 'mu')}, {cols('y', 4, 12)} FROM model_y"
        ),
        "first_moment": ctes(
            {**scaled, "m1": first_moments(3, "docs", N_ORDERS)},
            " UNION ALL ".join(f"SELECT {j} AS i, {rnd(f'm{j}', 11, 'val')} FROM m1" for j in range(3)),
        ),
        "third_moment_sums": ctes({**scaled, "w": w_sql, "sums": sums_sql}, f"SELECT part, i, j, l, {rnd('val', 6, 'val')} FROM sums"),
        "third_moment": ctes(
            {**scaled, "m1": first_moments(3, "docs", N_ORDERS), "cells": tensor_cells(3, "docs", "m1")}, f"SELECT i, j, l, {rnd('val', 10, 'val')} FROM cells"
        ),
        "third_moment_word_corrected": word_corrected_tensor(),
        "matrix_sum": "SELECT l_partkey AS row_id, sum(l_quantity) AS v0, count(*)::DOUBLE AS v1 FROM lineitem GROUP BY 1",
        "gaussian_matrix": gaussian(5, 20_010),
        "gram_matrix": ctes(
            {"y": vectors(4)},
            " UNION ALL ".join(f"SELECT {a} AS a, {b} AS b, {rnd(f'sum(y{a} * y{b})', 7, 'val')} FROM y" for a in range(4) for b in range(a, 4)),
        ),
        "orthonormal_columns": ctes(
            {
                "y": vectors(3),
                "q0": "SELECT word_id, y0 / (SELECT sqrt(sum(y0 * y0)) FROM y) AS q0, y1, y2 FROM y",
                "r1": "SELECT word_id, q0, y1 - (SELECT sum(q0 * y1) FROM q0) * q0 AS v1, y2 - (SELECT sum(q0 * y2) FROM q0) * q0 AS v2 FROM q0",
                "q1": "SELECT word_id, q0, v1 / (SELECT sqrt(sum(v1 * v1)) FROM r1) AS q1, v2 FROM r1",
                "r2": "SELECT word_id, q0, q1, v2 - (SELECT sum(q1 * v2) FROM q1) * q1 AS v2 FROM q1",
                "q2": "SELECT word_id, q0, q1, v2 / (SELECT sqrt(sum(v2 * v2)) FROM r2) AS q2 FROM r2",
            },
            "SELECT word_id, " + ", ".join(rnd(f"q{j}", 10, f"y{j}") for j in range(3)) + " FROM q2",
        ),
        "unit_columns": ctes(
            {"y": vectors(3), "n": "SELECT " + ", ".join(f"sqrt(sum(y{j} * y{j})) AS n{j}" for j in range(3)) + " FROM y"},
            "SELECT word_id, " + ", ".join(rnd(f"y{j} / n{j}", 9, f"y{j}") for j in range(3)) + f", {cols('n', 3, 9)} FROM y, n",
        ),
        "tall_small_product": ctes(
            {"y": vectors(3)},
            f"SELECT word_id, {rnd('y0 - 2 * y1', 10, 'z0')}, {rnd(f'{num(0.5)} * y0 + {num(0.25)} * y1 + 3 * y2', 10, 'z1')} FROM y",
        ),
        "spectral_factor": ctes(
            {**text, **corrected(2, N_TEXTS), **spectral2("model_y", "factor")}, f"SELECT word_id, {cols('o', 2, 8)}, {cols('s', 2, 8)} FROM factor"
        ),
        "range_finder": ctes(
            {**text, **range2(N_TEXTS)},
            f"""SELECT word_id, {rnd('coalesce(o0, 0)', 8, 'o0')}, {rnd('coalesce(o1, 0)', 8, 'o1')},
            {rnd('(SELECT any_value(s0) FROM factor)', 8, 's0')}, {rnd('(SELECT any_value(s1) FROM factor)', 8, 's1')}
            FROM vocabulary LEFT JOIN factor USING (word_id)""",
        ),
        "factor_lookup": ctes(
            sales,
            f"""SELECT i, j, l, val, {rnd('b.f0', 10, 'p0')}, {rnd('b.f1', 10, 'p1')}, {rnd('c.f0', 10, 'q0')}, {rnd('c.f1', 10, 'q1')}
            FROM sales JOIN fb b ON b.idx = j JOIN fc c ON c.idx = l""",
        ),
        "mttkrp": ctes(
            sales,
            " UNION ALL ".join(
                f"SELECT '{MODES[m]}' AS mode, idx, {cols('f', 2, 5)} FROM ({mttkrp('sales', factor_names, m)})" for m in range(3)
            ),
        ),
        "als_update": ctes({**sales, **als_step("sales", factor_names, 1, "b1", rho=0.01)}, f"SELECT idx, {cols('f', 2, 7)} FROM b1"),
        "slice_merge": ctes({"f": part_model(2, "f", "idx")}, f"SELECT idx, {cols('f', 2, 10)} FROM f"),
        "cp_als": ctes(
            {**sales, **als_until("sales", "fb", "fc", ALS_TOLERANCE, ALS_ITERATIONS)},
            " UNION ALL ".join(
                f"SELECT '{name}' AS factor, idx, {cols('f', 2, 8)}, {rnd('n0', 4, 'lambda0')}, {rnd('n1', 4, 'lambda1')} FROM {source}, norms_end"
                for name, source in (("A", "fa_end"), ("B", "fb_end"), ("C", "fc_end"))
            ),
        ),
        "sign_vote": f"""SELECT p_partkey AS idx, {rnd('sin(p_partkey + 4)', 10, 'f0')}, {rnd('sin(p_partkey + 4)', 10, 'f1')},
            {rnd('sin(p_partkey + 4)', 10, 'f2')} FROM part""",
        "dirichlet_prior": ctes(
            {"lam": f"SELECT c_nationkey AS topic, count(*) / {num(10)} AS w FROM customer GROUP BY 1"},
            f"SELECT topic, {rnd(f'{A0} / (w * w) / sum(1 / (w * w)) OVER ()', 12, 'value')} FROM lam",
        ),
        "unwhiten": ctes(
            {"m": part_model(2), "g": gram2("m", "o")},
            # A diag(lambda) = [[0.9, 0.4], [-1.2, 0.3]]
            f"""SELECT word_id, {rnd(f'(o0 * (g11 * {num(0.9)} + g01 * {num(1.2)}) - o1 * (g00 * {num(1.2)} + g01 * {num(0.9)})) / (g00 * g11 - g01 * g01)', 12, 'f0')},
            {rnd(f'(o0 * (g11 * {num(0.4)} - g01 * {num(0.3)}) + o1 * (g00 * {num(0.3)} - g01 * {num(0.4)})) / (g00 * g11 - g01 * g01)', 12, 'f1')} FROM m, g""",
        ),
        "simplex_projection": ctes(
            {**events, **simplex("ev", "event_type", "event_id", "value", "p")}, f"SELECT event_type, event_id, {rnd('value', 10, 'value')} FROM p"
        ),
        "topic_recovery_rounds": admm(20),
        "recovered_topics": ctes(
            {
                "factors": f"""SELECT p_partkey AS word_id, p_retailprice / ({num(1000)} * d) + {wave('p_partkey', 0)} / d AS f0,
                    {wave('p_partkey', 1)} / d - p_size / ({num(30)} * d) AS f1 FROM part, (SELECT count(*)::DOUBLE AS d FROM part)""",
                **recovered("factors", 2),
            },
            f"SELECT word_id, topic, {rnd('prob', 10, 'prob')} FROM topics",
        ),
        "top_words": """SELECT topic, rank, word_id, prob FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY prob DESC, word_id)::INT AS rank
            FROM (SELECT l_suppkey AS topic, l_partkey AS word_id, sum(l_quantity) AS prob FROM lineitem GROUP BY 1, 2)) WHERE rank <= 10""",
        "running_sum": """SELECT event_type, event_id, (sum(cents) OVER w)::BIGINT AS running, row_number() OVER w AS position
            FROM (SELECT event_type, event_id, round(value * 100)::BIGINT AS cents FROM events)
            WINDOW w AS (PARTITION BY event_type ORDER BY cents DESC, event_id ROWS UNBOUNDED PRECEDING)""",
        "fit_topics": fit_two_topics(whitened=False),
        "fit_topics_whitened": fit_two_topics(whitened=True),
    }
    return out
