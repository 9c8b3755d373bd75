"""SQL that several queries' equivalents share: similarity of names, as DuckDB can say it."""

from __future__ import annotations


def jaro_sql(a: str, b: str) -> str:
    """Jaro similarity with halves of transpositions counted: a fold over a's letters, whose state is the mask of b's taken letters, a bar and a's matched letters."""
    reach = f"(greatest(greatest(length({a}), length({b})) // 2, 1) - 1)"
    free = f"list_filter(range(greatest(1, i::int - {reach}), least(length({b}), i::int + {reach}) + 1), lambda j: substring(acc, j, 1) = '0' and substring({b}, j, 1) = substring({a}, i::int, 1))[1]"
    step = f"case when {free} is null then acc else substring(acc, 1, {free} - 1) || '1' || substring(acc, {free} + 1) || substring({a}, i::int, 1) end"
    state = f"list_reduce(list_prepend(repeat('0', length({b})) || '|', list_transform(range(1, length({a}) + 1), lambda k: k::varchar)), lambda acc, i: {step})"
    left = f"substring(st, length({b}) + 2)"
    right = f"array_to_string(list_transform(list_filter(range(1, length({b}) + 1), lambda j: substring(st, j, 1) = '1'), lambda j: substring({b}, j, 1)), '')"
    m = f"length({left})"
    turned = f"len(list_filter(range(1, {m} + 1), lambda k: substring({left}, k, 1) <> substring({right}, k, 1))) / 2"
    return f"(select case when {a} = {b} then 1.0 when {m} = 0 then 0.0 else ({m} / length({a}) + {m} / length({b}) + ({m} - {turned}) / {m}) / 3 end from (select {state} st))"


def jaro_winkler_sql(a: str, b: str) -> str:
    prefix = f"len(list_filter(range(1, least(4, length({a}), length({b})) + 1), lambda k: substring({a}, 1, k) = substring({b}, 1, k)))"
    return f"(select s + 0.1::double * {prefix} * (1 - s) from (select {jaro_sql(a, b)}::double s))"
