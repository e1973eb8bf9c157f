"""Common table expressions of the oracle SQL, composed by name."""

from __future__ import annotations

# Fixed values, written out here and not taken from the operators, so that a wrong bound there shows in the comparison.
AF_BINS = {"gnomad_001": (None, 0.0001), "gnomad_001_01": (0.0001, 0.001), "gnomad_01_1": (0.001, 0.01)}
COHORTS = ("case_pheno", "control_pheno", "case_null", "control_null")
IMPACT_BY_SIZE = ("MODIFIER", "LOW", "MODERATE", "HIGH")
TESTED_BINS = (
    "LOW.gnomad_001", "LOW.gnomad_001_01", "LOW.gnomad_01_1", "MODERATE.gnomad_001", "MODERATE.gnomad_001_01", "MODERATE.gnomad_01_1",
    "HIGH.gnomad_001", "HIGH.gnomad_001_01", "HIGH.gnomad_01_1", "total_burden",
)
FREQUENCIES = (None, 0.00005, 0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05)
PHENOTYPE = "BUILDING"
SET_TYPES = ("ECONOMY", "SMALL")


def case_of(key: str, values) -> str:
    arms = " ".join(
        f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)
    )
    return f"CASE {key} {arms} END"


def test_bin(bounds, af: str = "max_af") -> str:
    low, high = bounds
    parts = [f"{af} > {low!r}::DOUBLE"] if low is not None else []
    parts += [f"{af} < {high!r}::DOUBLE"] if high is not None else []
    return "(" + " AND ".join(parts) + ")"


def sum_if(test: str, value: str = "ac") -> str:
    return f"CAST(coalesce(sum({value}) FILTER (WHERE {test}), 0) AS BIGINT)"


def r(expr: str) -> str:
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0)"


def erfc(x: str) -> str:
    """By another method than the library's: a series of positive terms for small x, a continued fraction beyond."""
    down = "list_transform(range(0, 100), lambda i: 100.0::DOUBLE - i)"
    series = f"v * list_reduce(list_prepend(1.0::DOUBLE, {down}), lambda a, k: 1 + a * 2 * v * v / (2 * k + 1))"
    fraction = f"list_reduce(list_prepend(v, {down}), lambda a, k: v + k / 2 / a)"
    small = f"1 - 2 / sqrt(pi()) * exp(-v * v) * ({series})"
    large = f"exp(-v * v) / sqrt(pi()) / ({fraction})"
    return f"(list_transform([CAST({x} AS DOUBLE)], lambda v: CASE WHEN v < 1.5 THEN {small} WHEN v IS NOT NULL THEN {large} END)[1])"


def two_sided_p(z: str) -> str:
    return erfc(f"(abs({z}) / sqrt(2.0::DOUBLE))")


def neg_log10(p: str) -> str:
    return f"(-log10(greatest({p}, 4.9e-324::DOUBLE)))"


def bins_of(bins) -> str:
    return ", ".join(f"{sum_if(test_bin(b))} AS {name}" for name, b in bins.items())


BIN_SUMS = bins_of(AF_BINS)


def impact_bin(impact: str, bounds) -> str:
    return f"impact = '{impact}' AND {test_bin(bounds)}"


WIDE_CELLS = ", ".join(
    f"{sum_if(impact_bin(i, b))} AS \"{i}.{n}\"" for i in IMPACT_BY_SIZE for n, b in AF_BINS.items()
)

_SIDES = {
    "case_pheno": "is_case", "control_pheno": "NOT is_case",
    "case_null": "is_null_case", "control_null": "NOT is_null_case",
}


def _four_wide() -> str:
    cells = []
    for c, side in _SIDES.items():
        tests = [
            f"({side}) AND {impact_bin(i, b)}" for i in IMPACT_BY_SIZE if i != "MODIFIER" for b in AF_BINS.values()
        ]
        cells += [f"{sum_if(t)} AS {c}_{n}" for n, t in enumerate(tests)]
        cells.append(f"{sum_if(' OR '.join(f'({t})' for t in tests))} AS {c}_{len(tests)}")
    last = len(TESTED_BINS) - 1
    alive = " AND ".join(f"{c}_{last} > 0" for c in COHORTS)
    return (
        f"SELECT * FROM (SELECT gene, {', '.join(cells)} FROM labelled_entries GROUP BY gene) WHERE {alive}"
    )


def _four_long() -> str:
    return " UNION ALL ".join(
        f"SELECT gene, '{b}' AS bin, " + ", ".join(f"{c}_{i} AS ac_{c}" for c in COHORTS) + " FROM four_wide"
        for i, b in enumerate(TESTED_BINS)
    )


def _sim() -> str:
    parts = []
    for i, b in enumerate(TESTED_BINS):
        sums = ", ".join(
            f"CAST(sum({c}_{i}) AS BIGINT) AS ac_{c}, count(*) FILTER (WHERE {c}_{i} > 0) AS n_{c}" for c in COHORTS
        )
        parts.append(
            f"SELECT iter, '{b}' AS bin, count(*) AS k, {sums} FROM set_genes GROUP BY iter"
        )
    return " UNION ALL ".join(parts)


def sampled(seed: int, genes: str, k: int = 10) -> str:
    """SQL of ``sample_gene_sets``, one nested step per drawn gene; a population below ``k`` is taken whole."""
    steps = f"SELECT c_custkey AS iter, (SELECT count(*) FROM {genes}) AS n, []::INTEGER[] AS taken FROM customer"
    for i in range(k):
        last = f"(n - least(n, {k}) + {i})"
        draw = f"CAST(('0x' || substr(md5('{seed}:' || iter || ':{i}'), 1, 15))::BIGINT % ({last} + 1) AS INTEGER)"
        steps = f"""SELECT iter, n, CASE WHEN {i} >= n THEN taken
            ELSE list_append(taken, CASE WHEN list_contains(taken, draw) THEN CAST({last} AS INTEGER) ELSE draw END) END AS taken
            FROM (SELECT *, {draw} AS draw FROM ({steps}))"""
    return f"""SELECT iter, unnest(range(len(taken))) AS pos, unnest(taken) AS gene_idx FROM ({steps})"""


CTES = {
    "variants": ((), f"""
        SELECT CAST(1 + p_partkey % 22 AS VARCHAR) AS contig, CAST(p_partkey AS INTEGER) AS pos,
               CASE WHEN p_partkey % 89 = 0 THEN ['A', 'T', 'G'] WHEN p_partkey % 97 = 0 THEN ['A', '*']
                    ELSE ['A', 'T'] END AS alleles,
               p_brand || '.' || p_type AS gene, {case_of('p_size % 4', IMPACT_BY_SIZE)} AS impact,
               CAST(p_partkey AS INTEGER) AS hgnc_id,
               CAST({case_of('p_partkey % 8', FREQUENCIES)} AS DOUBLE) AS max_af
        FROM part"""),
    "calls": ((), """
        SELECT o_custkey AS s, CAST(l_partkey AS INTEGER) AS pos,
               CASE l_linenumber % 3 WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' ELSE '1/1' END AS gt,
               CAST(l_quantity * 2 AS INTEGER) AS dp,
               CAST(floor(CAST(l_quantity * 2 AS INTEGER) * l_linenumber / 7.0::DOUBLE) AS INTEGER) AS ad1,
               l_linenumber % 3 AS ac
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "entries": (("variants", "calls"), """
        SELECT c.*, CASE WHEN dp <> 0 THEN ad1::DOUBLE / dp END AS vf,
               v.contig, v.alleles, v.gene, v.impact, v.hgnc_id, v.max_af
        FROM calls c JOIN variants v ON c.pos = v.pos"""),
    "kept": (("entries",), """
        SELECT * FROM entries
        WHERE alleles[2] <> '*' AND max_af < 0.01::DOUBLE AND vf >= 0.3::DOUBLE AND dp > 30"""),
    "samples": ((), """
        SELECT c_custkey AS s, c_mktsegment || ',N' || c_nationkey AS phenotype, c_name AS mutation FROM customer"""),
    "labelled": (("samples",), f"""
        SELECT *, (NOT is_case AND
                   row_number() OVER (PARTITION BY is_case ORDER BY md5('null-cohort:' || s), s)
                   <= count(*) FILTER (WHERE is_case) OVER ()) AS is_null_case
        FROM (SELECT *, list_contains(string_split(phenotype, ','), '{PHENOTYPE}') AS is_case FROM samples)"""),
    "labelled_entries": (("kept", "labelled"), """
        SELECT k.*, l.is_case, l.is_null_case FROM kept k JOIN labelled l ON k.s = l.s"""),
    "four_wide": (("labelled_entries",), _four_wide()),
    "four_long": (("four_wide",), _four_long()),
    "sizes": (("labelled",), """
        SELECT count(*) FILTER (WHERE is_case) AS case_pheno, count(*) FILTER (WHERE NOT is_case) AS control_pheno,
               count(*) FILTER (WHERE is_null_case) AS case_null,
               count(*) FILTER (WHERE NOT is_null_case) AS control_null
        FROM labelled"""),
    "gene_list": ((), f"""
        SELECT DISTINCT p_brand || '.' || p_type AS gene FROM part WHERE p_type IN {SET_TYPES}"""),
    "genes": (("four_wide",), """
        SELECT *, CAST(row_number() OVER (ORDER BY substr(md5('order:' || gene), 1, 3), gene) - 1 AS INTEGER)
               AS gene_idx FROM four_wide"""),
    "listed": (("four_wide", "gene_list"), """
        SELECT *, CAST(row_number() OVER (ORDER BY substr(md5('order:' || gene), 1, 3), gene) - 1 AS INTEGER)
               AS gene_idx FROM four_wide WHERE gene IN (SELECT gene FROM gene_list)"""),
    "sets": (("genes",), sampled(12345, "genes")),
    "listed_sets": (("listed",), sampled(12345, "listed")),
    "set_genes": (("sets", "genes"), "SELECT s.iter, g.* FROM sets s JOIN genes g ON s.gene_idx = g.gene_idx"),
    "sums": (("set_genes",), _sim()),
    "listed_set_genes": (
        ("listed_sets", "listed"),
        "SELECT s.iter, g.* FROM listed_sets s JOIN listed g ON s.gene_idx = g.gene_idx",
    ),
    "listed_sums": (("listed_set_genes",), _sim().replace("FROM set_genes", "FROM listed_set_genes")),
}


def _ratios(source: str) -> str:
    sums = ", ".join(f"ac_{c} + k * 0.01::DOUBLE AS sum_{c}" for c in COHORTS)
    sides = ", ".join(
        f"sum_case_{s} / sum_control_{s} AS ratio_{s}, (sum_case_{s} > 1.0 AND sum_control_{s} > 1.0) AS valid_{s}"
        for s in ("pheno", "null")
    )
    return f"SELECT *, {sides} FROM (SELECT *, {sums} FROM {source})"


def _logs(source: str) -> str:
    logs = ", ".join(
        f"CASE WHEN valid_{s} THEN log2(ratio_{s} / (z.case_{s}::DOUBLE / z.control_{s})) END AS log2_{s}"
        for s in ("pheno", "null")
    )
    return f"SELECT r.*, {logs} FROM {source} r, sizes z"


for prefix in ("", "listed_"):
    CTES[f"{prefix}ratios"] = ((f"{prefix}sums",), _ratios(f"{prefix}sums"))
    CTES[f"{prefix}logs"] = ((f"{prefix}ratios", "sizes"), _logs(f"{prefix}ratios"))
    CTES[f"{prefix}cuts"] = ((f"{prefix}logs",), f"""
        SELECT bin, quantile_cont(log2_pheno, 0.99) AS threshold, count(log2_pheno) AS n_values
        FROM {prefix}logs GROUP BY bin HAVING count(log2_pheno) > 0""")
    CTES[f"{prefix}top"] = ((f"{prefix}logs", f"{prefix}cuts"), f"""
        SELECT l.*, c.threshold FROM {prefix}logs l JOIN {prefix}cuts c ON l.bin = c.bin
        WHERE c.n_values >= 20 AND l.log2_pheno > c.threshold""")


def with_(names: str, body: str) -> str:
    """Prefix ``body`` with the named expressions and all they depend on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for n in names.split():
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in ordered) + "\n" + body



def extended(names: str, more: str, body: str) -> str:
    """As ``with_``, with further expressions after the named ones."""
    return f"{with_(names, '').rstrip()}{more}\n{body}"
