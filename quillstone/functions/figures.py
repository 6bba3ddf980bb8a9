"""Column expressions over figures in text: extraction, grounding, tolerance, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.reference import ANSWER_SCALES, REFUSALS, SCALE_WORDS

# What counts as a figure of an answer; as a number of a source; as a number of an evaluated text.
FIGURE = r"(?U)\$\d[\d,]*(?:\.\d+)?(?:\s?(?:billion|million|thousand|B|M|K))?\b|\d+(?:\.\d+)?%|\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b"
NUMBER = r"(?U)\d[\d,]*(?:\.\d+)?"
STATED = r"(\d[\d,]*)(?:\.(\d+))?\s?(billion|million|thousand|B|M|K)?\b"
EVALUATED = r"\$?\d[\d,]*\.?\d*\s*(?:[BMKTbmkt](?:illion|rillion)?)?\b|\d+\.?\d*\s*%"


def figures(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FIGURE), F.lit(0))


def magnitude(token: Column) -> Column:
    """The number in a figure, commas and sign aside."""
    return F.regexp_replace(F.regexp_extract(token, NUMBER, 0), ",", "").try_cast("double")


def source_values(text: Column) -> Column:
    """The distinct magnitudes of all numbers in a text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, magnitude), lambda v: v.isNotNull()))


def grounded(found: Column, values: Column) -> Column:
    """The figures whose magnitude is among the values; order and repeats stay."""
    return F.filter(found, lambda f: F.coalesce(F.array_contains(values, magnitude(f)), F.lit(False)))


def not_grounded(found: Column, values: Column) -> Column:
    return F.filter(found, lambda f: ~F.coalesce(F.array_contains(values, magnitude(f)), F.lit(False)))


def states_value(figure: Column, value: Column) -> Column:
    """Whether a figure states a value, rounded to half a unit of the precision it is written at."""
    whole, frac, word = (F.regexp_extract(figure, STATED, i) for i in (1, 2, 3))
    number = F.concat(F.regexp_replace(whole, ",", ""), F.when(frac != "", F.concat(F.lit("."), frac)).otherwise("")).try_cast("double")
    half = F.lit(0.5) * F.pow(F.lit(10.0), -F.length(frac))
    scale = F.create_map(*(F.lit(x) for item in SCALE_WORDS.items() for x in item))
    scales = F.when(word != "", F.array(scale[F.lower(word)])).otherwise(F.array(*map(F.lit, (1.0, 1e3, 1e6, 1e9))))
    return (whole != "") & F.exists(scales, lambda s: F.abs(number * s - F.abs(value)) <= half * s + F.lit(1e-9))


def states_any(figure: Column, values: Column) -> Column:
    """Percentages are computed, not reported, so none is ever stated by a value."""
    return ~figure.endswith("%") & F.exists(values, lambda v: states_value(figure, v))


def shown(value: Column, unit: Column) -> Column:
    """A value as a filing prints it."""
    million = F.format_number(F.abs(value) / 1e6, 1)
    sign = F.when(value < 0, "-").otherwise("")
    usd = F.concat(sign, F.lit("$"), F.when(F.abs(value) >= 1e6, F.concat(million, F.lit(" million"))).otherwise(F.format_number(F.abs(value), 0)))
    each = F.concat(F.lit("$"), F.format_number(value, 2), F.lit(" per share"))
    shares = F.when(F.abs(value) >= 1e6, F.concat(F.format_number(value / 1e6, 1), F.lit(" million shares"))).otherwise(F.concat(F.format_number(value, 0), F.lit(" shares")))
    return F.when(unit == "USD", usd).when(unit == "USD/shares", each).when(unit == "shares", shares).otherwise(F.call_function("format_number", value, F.lit("#,##0.###############")))


# Endings of an evaluated number and what they multiply it by.
EVALUATED_SCALES = {"b": 1e9, "billion": 1e9, "m": 1e6, "million": 1e6, "k": 1e3, "thousand": 1e3, "t": 1e12, "trillion": 1e12}


def evaluated_numbers(text: Column, floor: float | None = None) -> Column:
    """The numbers of an evaluated text; a B, M, K or T, alone or at the head of its word, scales them.

    As published, the word thousand does not, nor does a per cent sign.
    """
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(EVALUATED), F.lit(0))

    def value(raw: Column) -> Column:
        s = F.trim(F.regexp_replace(F.lower(raw), r"[,$]", ""))
        scale = F.lit(1.0)
        for ending, by in reversed(EVALUATED_SCALES.items()):
            scale = F.when(F.endswith(s, F.lit(ending)), by).otherwise(scale)
        return F.regexp_extract(s, r"^\d+\.?\d*", 0).try_cast("double") * scale

    numbers = F.filter(F.transform(found, value), lambda v: v.isNotNull())
    return numbers if floor is None else F.filter(numbers, lambda v: F.abs(v) > floor)


def near(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-9)) <= tolerance


def states_truth(answer: Column, truth: Column, tolerance: float = 0.02, floor: float = 1.5) -> Column:
    """Whether an answer holds a number of the truth at any scale; null if the truth has none."""
    wanted, have = evaluated_numbers(truth, floor), evaluated_numbers(answer, floor)
    scales = F.array(*map(F.lit, ANSWER_SCALES))
    hit = F.exists(wanted, lambda g: F.exists(have, lambda a: F.exists(scales, lambda s: near(a, g * s, tolerance))))
    return F.when(F.size(wanted) > 0, hit)


def declines(answer: Column) -> Column:
    return answer.rlike("(?i)" + "|".join(REFUSALS))


def precision(answer_numbers: Column, context_numbers: Column, tolerance: float = 0.01) -> Column:
    """The share of an answer's numbers that its contexts hold; 1 if it has none."""
    hit = F.filter(answer_numbers, lambda a: F.exists(context_numbers, lambda c: F.when(c == 0, a == 0).otherwise(near(a, c, tolerance))))
    return F.when(F.size(answer_numbers) == 0, 1.0).otherwise(F.size(hit) / F.size(answer_numbers))


def evidence_numbers(numbers: Column) -> Column:
    """Those of 100 and more that are no year from 1990 to 2035."""
    return F.array_distinct(F.filter(numbers, lambda n: (F.abs(n) >= 100) & ~((n >= 1990) & (n <= 2035) & (n == F.floor(n)))))


def covers(chunk_numbers: Column, wanted: Column, tolerance: float = 0.001) -> Column:
    """Whether a chunk holds three of the wanted numbers, or all if there are fewer."""
    hits = F.size(F.filter(wanted, lambda w: F.exists(chunk_numbers, lambda h: F.abs(w - h) / F.greatest(F.abs(w), F.lit(1e-9)) <= tolerance)))
    return (F.size(wanted) > 0) & (hits >= F.least(F.lit(3), F.size(wanted)))
