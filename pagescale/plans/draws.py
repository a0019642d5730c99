"""SQL of repeatable draws: hashed orders, keyed permutations and the combinatorial number system, for the comparison engine."""

from __future__ import annotations

from pagescale.operators.sampling import ROUNDS


def chance(*parts: object) -> str:
    return f"('0x'||substr(md5(concat_ws('/', {', '.join(map(str, parts))})), 1, 15))::BIGINT"


def choose(n: str, k: int) -> str:
    """The number of subsets of k out of n, factor by factor."""
    out = "1::BIGINT"
    for i in range(1, k + 1):
        out = f"({out}*({n}-{k - i})//{i})"
    return out


def draws(total: str, plan: dict[int, tuple[str, int]], seed: int) -> str:
    """CTEs up to ``drawn`` (k, group_no, m); ``plan`` has for each size the number of draws and of residue classes."""
    ctes, ends = [], []
    for k, (count, s) in plan.items():
        parts = [(f"((n_all-{q}+{s - 1})//{s})", (k - q + s - 1) // s) for q in range(s)]
        sizes = [choose(n, m) for n, m in parts]
        wanted = f"least({count}, {'*'.join(f'{x}::HUGEINT' for x in sizes)})::BIGINT"
        ctes.append(f"n{k} AS (SELECT n_all, {wanted} AS wanted FROM (SELECT {total.replace(' FROM', ' AS n_all FROM')}))")
        ctes.append(f"g{k} AS (SELECT n_all, g AS id, g AS rest, []::BIGINT[] AS m FROM (SELECT n_all, unnest(range(0, wanted)) AS g FROM n{k}))")
        prev, known = f"g{k}", []
        for q, ((n, m), size) in enumerate(zip(parts, sizes, strict=True)):
            digit = f"rest % size{q}" if not known else f"(rest + {chance(seed, k, -1, *known)} % size{q}) % size{q}"
            known.append(f"d{q}")
            steps = [f"{size} AS size{q}", f"{digit} AS d{q}", f"length(CAST({size} AS VARCHAR)) AS len", "CASE WHEN len > 1 THEN CAST(power(10, (len+1)//2) AS BIGINT) ELSE 1 END AS high", f"size{q}//high AS low", f"d{q}//low AS l0", f"d{q}%low AS r0"]
            for r in range(1, ROUNDS + 1):
                if r % 2:
                    steps += [f"(l{r - 1} + {chance(seed, k, 100 + q, r, f'r{r - 1}')} % high) % high AS l{r}", f"r{r - 1} AS r{r}"]
                else:
                    steps += [f"(r{r - 1} + {chance(seed, k, 100 + q, r, f'l{r - 1}')} % low) % low AS r{r}", f"l{r - 1} AS l{r}"]
            turned = f"(CASE WHEN d{q} < high*low THEN l{ROUNDS}*low + r{ROUNDS} ELSE d{q} END + {chance(seed, k, 100 + q, 0)} % size{q}) % size{q} AS x{q}"
            kept = ", ".join(["n_all", "id", f"rest//size{q} AS rest", "m", *known, f"x{q}"])
            ctes.append(f"p{k}_{q} AS (SELECT {kept} FROM (SELECT *, {turned} FROM (SELECT *, {', '.join(steps)} FROM {prev})))")
            prev = f"p{k}_{q}"
            for j in range(m, 0, -1):
                ctes.append(f"b{k}_{q}_{j} AS (SELECT c, {choose('c', j)} AS v FROM (SELECT unnest(range({j - 1}, {n})) AS c FROM n{k}))")
                ctes.append(f"u{k}_{q}_{j} AS (SELECT t.* REPLACE (t.x{q} - b.v AS x{q}, list_append(t.m, b.c*{s}+{q}) AS m) FROM {prev} t ASOF JOIN b{k}_{q}_{j} b ON t.x{q} >= b.v)")
                prev = f"u{k}_{q}_{j}"
        ends.append(f"SELECT {k} AS k, id AS group_no, list_sort(m) AS m FROM {prev}")
    return ",\n".join([*ctes, f"drawn AS ({' UNION ALL '.join(ends)})"])
