"""Invertible rewriting of integers and delimiters in text, as Column expressions.

An integer is a run of ASCII digits with an optional minus sign, touching neither a point nor another digit. A text is
split at its integers, each is rewritten on its own, and the pieces are joined again: split, extract, zip, join, all inside
whole-stage codegen. Decimals of 38 digits carry the arithmetic. Texts with a run of more digits than that allows go through
exact Python integers (``exact``), so that integers of any length are rewritten; ``apply_transform`` and ``rewrite_dataset``
send only such rows there.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what counts as an integer.
INTEGER = r"(?<![.0-9])(-?[0-9]+)(?![.0-9])"
_DEC = "decimal(38,0)"


def find_integers(text: Column) -> Column:
    """All integers of a text, in order, as strings."""
    return F.regexp_extract_all(text, F.lit(INTEGER), F.lit(1))


def rewrite(text: Column, change: Callable[[Column], Column], digits: int) -> Column:
    """Replace each integer of at most ``digits`` digits by ``change`` of it; where that is null the integer stays."""
    found = find_integers(text)
    parts = F.split(text, INTEGER, -1)

    def one(m: Column) -> Column:
        fits = F.length(F.regexp_replace(m, "^-?0*", "")) <= digits
        return F.when(fits, F.coalesce(change(F.when(fits, m).otherwise("0")), m)).otherwise(m)

    tail = F.zip_with(F.transform(found, one), F.slice(parts, F.lit(2), F.size(found)), lambda m, p: F.concat(m, p))
    return F.when(text.isNotNull(), F.concat(F.element_at(parts, 1), F.array_join(tail, "")))


def _text(x: Column) -> Column:
    return x.cast(_DEC).cast("string")


def _whole(x: Column, by: int) -> Column:
    """x / by as a decimal without fraction, where ``by`` divides x."""
    return F.when(x % F.lit(by).cast(_DEC) == 0, (x / F.lit(by).cast("decimal(6,0)")).cast(_DEC))


def _hex_value(m: Column) -> Column:
    """The decimal digits of an integer read as a numeral of base 16."""
    digits = F.regexp_replace(m, "^-?0*", "")
    value = F.when(digits == "", "0").otherwise(F.conv(F.when(digits == "", "0").otherwise(digits), 16, 10))
    return F.when(m.startswith("-") & (value != "0"), F.concat(F.lit("-"), value)).otherwise(value)


def _hex_digits(m: Column) -> Column:
    """An integer written in base 16, null where that needs letters."""
    digits = F.regexp_replace(m, "^-?0*", "")
    value = F.when(digits == "", "0").otherwise(F.conv(F.when(digits == "", "0").otherwise(digits), 10, 16))
    plain = F.when(value.rlike("^[0-9]+$"), value)
    return F.when(m.startswith("-") & (plain != "0"), F.concat(F.lit("-"), plain)).otherwise(plain)


def _cube_root(x: Column) -> Column:
    """The integer whose cube is x, null where there is none; a double tells roots of 11 digits apart."""
    root = F.round(F.cbrt(F.abs(x).cast("double"))).cast("decimal(12,0)")
    exact = (root * root).cast("decimal(24,0)") * root == F.abs(x)
    return F.when(exact, F.when(x < 0, -root.cast(_DEC)).otherwise(root.cast(_DEC)))


@dataclass(frozen=True)
class Transform:
    """A named invertible transform: parameters, both directions as Columns and as Python functions, and the contract."""

    name: str
    params: dict = field(default_factory=dict)

    def forward(self, text: Column) -> Column:
        return text

    def inverse(self, text: Column) -> Column:
        return text

    def python(self, text: str, back: bool = False) -> str:
        return text

    #: Most digits of an integer that the expressions rewrite, forward and back; 0: any number.
    long_run = 0
    long_back = 0

    def is_long(self, text: Column, back: bool = False) -> Column:
        """Whether a text holds a run of more digits than the expressions rewrite; null as false."""
        most = self.long_back if back else self.long_run
        return F.coalesce(text.rlike(f"[0-9]{{{most + 1},}}"), F.lit(False)) if most else F.lit(False)

    def contract(self) -> str:
        # Fixed value: the wording.
        return "### Encoding Contract (must follow exactly)\nInput and output use standard formatting (no encoding applied).\nProcess values as-is.\n"


def _python_rewrite(text: str, change: Callable[[int], int | str | None]) -> str:
    import re
    import sys

    sys.set_int_max_str_digits(0)
    return re.sub(r"(?<![.0-9])-?[0-9]+(?![.0-9])", lambda m: str(new) if (new := change(int(m.group()))) is not None else m.group(), text)


def _signed(n: int) -> str:
    return f"{'+' if n >= 0 else '-'} {abs(n)}"


class Affine(Transform):
    """x becomes a x + b."""

    long_run, long_back = 28, 30

    def forward(self, text: Column) -> Column:
        a, b = self.params["a"], self.params["b"]
        return rewrite(text, lambda m: _text(m.cast("decimal(30,0)") * F.lit(a).cast("decimal(4,0)") + F.lit(b).cast("decimal(4,0)")), self.long_run)

    def inverse(self, text: Column) -> Column:
        a, b = self.params["a"], self.params["b"]
        return rewrite(text, lambda m: _whole(m.cast("decimal(30,0)").cast("decimal(31,0)") - F.lit(b).cast("decimal(4,0)"), a).cast("string"), self.long_back)

    def python(self, text: str, back: bool = False) -> str:
        a, b = self.params["a"], self.params["b"]
        return _python_rewrite(text, (lambda x: (x - b) // a if (x - b) % a == 0 else None) if back else (lambda x: a * x + b))

    def contract(self) -> str:
        a, b = self.params["a"], self.params["b"]
        # Fixed value: the wording.
        return f"""### Encoding Contract (must follow exactly)
All integers in the input have been encoded using the formula: x' = {a}*x {_signed(b)}
To decode an input integer: x = (x' {_signed(-b) if b else '- 0'}) / {a}
Your output integers must also be encoded the same way.

Examples:
- An input value that appears as {10 * a + b} represents the original value 10
- If your computed answer is 10, you must output {10 * a + b}
- If your computed answer is 0, you must output {b}
"""


class Cubic(Transform):
    """x becomes x cubed + c."""

    long_run, long_back = 11, 33

    def forward(self, text: Column) -> Column:
        c = F.lit(self.params["c"]).cast("decimal(4,0)")

        def cube(m: Column) -> Column:
            x = m.cast("decimal(12,0)")
            return _text((x * x).cast("decimal(24,0)") * x + c)

        return rewrite(text, cube, self.long_run)

    def inverse(self, text: Column) -> Column:
        c = F.lit(self.params["c"]).cast("decimal(4,0)")
        return rewrite(text, lambda m: _cube_root(m.cast("decimal(34,0)") - c).cast("string"), self.long_back)

    def python(self, text: str, back: bool = False) -> str:
        c = self.params["c"]

        def root(x: int) -> int | None:
            n = abs(x - c)
            r = round(n ** (1 / 3)) if n < 1 << 60 else 1 << -(-n.bit_length() // 3)
            while r**3 > n:
                r = (2 * r + n // (r * r)) // 3
            while (r + 1) ** 3 <= n:
                r += 1
            return (r if x >= c else -r) if r**3 == n else None

        return _python_rewrite(text, root if back else (lambda x: x**3 + c))

    def contract(self) -> str:
        c = self.params["c"]
        # Fixed value: the wording.
        return f"""### Encoding Contract (must follow exactly)
All integers in the input have been encoded using the formula: x_enc = x_orig**3 {_signed(c)}
To decode an encoded input integer `x_enc`, use:
    val = x_enc {_signed(-c) if c else '- 0'}
    x_orig = int(round(abs(val) ** (1/3))) * (1 if val >= 0 else -1)
To encode an original integer `x_orig`, use:
    x_enc = x_orig**3 {_signed(c)}
Your output integers must also be encoded the same way.

Examples:
- An input value that appears as {125 + c} represents the original value 5
- If your computed answer is 5, you must output {125 + c}
- If your computed answer is 0, you must output {c}
"""


class BaseDigits(Transform):
    """The decimal digits of x are read as a numeral of base 16."""

    long_run, long_back = 15, 18

    def forward(self, text: Column) -> Column:
        return rewrite(text, _hex_value, self.long_run)

    def inverse(self, text: Column) -> Column:
        return rewrite(text, _hex_digits, self.long_back)

    def python(self, text: str, back: bool = False) -> str:
        def plain(x: int) -> str | None:
            s = format(x, "x")
            return s if s.lstrip("-").isdigit() else None

        return _python_rewrite(text, plain if back else (lambda x: int(str(x), 16)))

    def contract(self) -> str:
        # Fixed value: the wording.
        return """### Encoding Contract (must follow exactly)
All integers have been re-encoded: each digit string is reinterpreted as a base-16 numeral.
To decode an encoded input integer `x_enc`, use:
    sign = "-" if x_enc < 0 else ""
    x_orig = int(f"{sign}{abs(x_enc):x}")
To encode an original integer `x_orig`, use:
    x_enc = int(str(x_orig), 16)
Your output integers must also be encoded the same way.

Examples:
- An input value 66 represents the original value 42 (because "42" in base 16 = 66 in decimal)
- If your computed answer is 42, you must output 66
- If your computed answer is 0, you must output 0
"""


#: Fixed values: (delimiter in, delimiter out, opening, closing) of the delimiter styles.
STYLES = ((" ", ",", "", ""), (" ", ", ", "[", "]"), ("\n", ";", "", ""))
_NAMES = {" ": "space", "\n": "newline", ",": "comma", ", ": "comma-space", ";": "semicolon"}


class Delimiter(Transform):
    """Delimiters within lines, or between them, are replaced, and such lines put in brackets."""

    def _style(self) -> tuple[str, str, str, str]:
        return STYLES[self.params["style"]]

    def forward(self, text: Column) -> Column:
        old, new, left, right = self._style()
        if old == "\n":
            return F.replace(text, F.lit(old), F.lit(new))
        return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.when(F.contains(x, F.lit(old)), F.concat(F.lit(left), F.replace(x, F.lit(old), F.lit(new)), F.lit(right))).otherwise(x)), "\n")

    def inverse(self, text: Column) -> Column:
        old, new, left, right = self._style()
        if old == "\n":
            return F.replace(text, F.lit(new), F.lit(old))

        def line(x: Column) -> Column:
            if left:
                x = F.when(x.startswith(left) & x.endswith(right), F.substring(x, F.lit(2), F.greatest(F.length(x) - 2, F.lit(0)))).otherwise(x)
            return F.replace(x, F.lit(new), F.lit(old))

        return F.array_join(F.transform(F.split(text, "\n", -1), line), "\n")

    def python(self, text: str, back: bool = False) -> str:
        old, new, left, right = self._style()
        if old == "\n":
            return text.replace(new, old) if back else text.replace(old, new)
        out = []
        for x in text.split("\n"):
            if back:
                if left and x.startswith(left) and x.endswith(right):
                    x = x[1:-1]
                out.append(x.replace(new, old))
            else:
                out.append(left + x.replace(old, new) + right if old in x else x)
        return "\n".join(out)

    def contract(self) -> str:
        old, new, left, right = self._style()
        plain = "1 2 3" if old == " " else "1\n2\n3"
        note = f"Values are wrapped in {left!r} and {right!r}." if left else ""
        shown = plain.replace("\n", "\\n")
        # Fixed value: the wording.
        return f"""### Encoding Contract (must follow exactly)
Values are delimited by {_NAMES[new]} instead of {_NAMES[old]}.
{note}
Your output must use the same delimiter format.

Examples:
- Input "{self.python(plain)}" represents "{shown}"
- Format your output the same way
"""


def sample_params(name: str, seed: int) -> dict:
    """Parameters of a family drawn from a seed."""
    rng = random.Random(seed)
    if name == "affine_int":
        return {"a": rng.choice([2, 3, 5, 7, 11]), "b": rng.randint(-100, 100)}
    if name == "cubic_int":
        return {"c": rng.randint(-50, 50)}
    if name in ("basek_int", "base_conv"):
        return {"base": 16}
    if name == "delimiter_rewrite":
        return {"style": rng.choice(range(len(STYLES)))}
    if name == "identity":
        return {"identity": True}
    raise ValueError(f"no transform {name}; there are {sorted(REGISTRY)}")


REGISTRY: dict[str, type[Transform]] = {"affine_int": Affine, "cubic_int": Cubic, "basek_int": BaseDigits, "base_conv": BaseDigits, "delimiter_rewrite": Delimiter, "identity": Transform}


def transform(name: str, seed: int | None = None, params: dict | None = None) -> Transform:
    """A transform by name, with given parameters or those of a seed."""
    if name not in REGISTRY:
        raise ValueError(f"no transform {name}; there are {sorted(REGISTRY)}")
    canonical = "basek_int" if name == "base_conv" else name
    return REGISTRY[name](canonical, params if params is not None else sample_params(name, seed or 0))


def exact(texts: Column, t: Transform, back: bool = False) -> Column:
    """An array of texts rewritten with Python's integers; null arrays and null texts stay null."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None else [None if s is None else t.python(s, back) for s in x])

    return run(texts)


def apply_transform(df: DataFrame, column: str, out: str, t: Transform, back: bool = False) -> DataFrame:
    """``df`` with ``out``: ``column`` rewritten, exact for integers of any length.

    Texts without a run of more digits than the expressions hold stay in the JVM; only the others go through Python. Null
    stays null; the row count is that of ``df``.
    """
    native = t.inverse(F.col(column)) if back else t.forward(F.col(column))
    if not t.long_run:
        return df.withColumn(out, native)
    long = t.is_long(F.col(column), back)
    return df.where(~long).withColumn(out, native).unionByName(df.where(long).withColumn(out, exact(F.array(column), t, back)[0]))


def roundtrip_proof(samples: Column, t: Transform, checked: int = 10, shown: int = 5, width: int = 100, forward: Column | None = None, inverse: Column | None = None) -> Column:
    """Struct of roundtrip_ok, n_checked and the first examples, over the first ``checked`` of an array of texts.

    A null array counts as empty; no samples are a proof of nothing and pass. ``forward`` and ``inverse`` are the arrays of
    rewritten and restored samples where they were made by ``exact``. Without them a text with a longer run than the
    expressions rewrite is no proof, and fails.
    """
    first = F.slice(F.coalesce(samples, F.array().cast("array<string>")), 1, checked)
    if forward is None:
        tried = F.transform(first, lambda s: F.struct(s.alias("orig"), t.forward(s).alias("fwd"), t.inverse(t.forward(s)).alias("inv"), t.is_long(s).alias("long")))
    else:
        zipped = F.arrays_zip(first.alias("orig"), F.slice(forward, 1, checked).alias("fwd"), F.slice(inverse, 1, checked).alias("inv"))
        tried = F.transform(zipped, lambda e: F.struct(e["orig"].alias("orig"), e["fwd"].alias("fwd"), e["inv"].alias("inv"), F.lit(False).alias("long")))

    def match(e: Column) -> Column:
        return e["orig"].eqNullSafe(e["inv"]) & ~e["long"]

    examples = F.transform(F.slice(tried, 1, shown), lambda e: F.struct(F.substring(e["orig"], 1, width).alias("orig"), F.substring(e["fwd"], 1, width).alias("fwd"), F.substring(e["inv"], 1, width).alias("inv"), match(e).alias("match")))
    return F.struct(F.forall(tried, match).alias("roundtrip_ok"), F.size(first).alias("n_checked"), examples.alias("examples"))


def append_contract(prompt: Column, contract: str) -> Column:
    """A prompt, a blank line, and the contract."""
    return F.concat(prompt, F.when(prompt.endswith("\n"), "").otherwise("\n"), F.lit("\n" + contract))


def encode_only_contract(t: Transform) -> str:
    """Contract for plain inputs and encoded outputs."""
    lines = [x for x in t.contract().splitlines() if x.startswith(("- If your computed", "To encode", "    x_enc ="))]
    return "\n".join(["### Output Encoding (must follow exactly)", "Inputs are given in their original, unencoded form.", "Your output integers must be encoded:" if not isinstance(t, Delimiter) else "Your output must use the encoded delimiters.", *lines]) + "\n"


def with_examples(contract: str, inputs: Column, outputs: Column, width: int = 80) -> Column:
    """A contract with the first two inputs and outputs of a problem, cut to ``width`` and quoted."""

    def shown(label: str, values: Column) -> Column:
        cut = F.transform(F.slice(F.coalesce(values, F.array().cast("array<string>")), 1, 2), lambda v: F.when(F.length(v) > width, F.concat(F.substring(v, 1, width), F.lit("..."))).otherwise(v))
        return F.array_join(F.transform(cut, lambda v, i: F.concat(F.lit(f"- Sample {label} "), (i + 1).cast("string"), F.lit(": "), python_repr(v), F.lit("\n"))), "")

    body = F.concat(shown("input", inputs), shown("output", outputs))
    return F.concat(F.lit(contract), F.when(F.length(body) > 0, F.concat(F.lit("\nConcrete examples from this problem:\n"), body)).otherwise(""))


def python_repr(text: Column) -> Column:
    """A text quoted as Python's repr does, for printable text, line breaks and tabs."""
    quote = F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), '"').otherwise("'")
    body = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    body = F.when(quote == "'", F.replace(body, F.lit("'"), F.lit("\\'"))).otherwise(body)
    return F.concat(quote, body, quote)
