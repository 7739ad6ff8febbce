"""Functions that built-ins cannot express, as Arrow-batched UDFs.

Unicode normalising (NFKD), number words, token predicates that fold first, edit
operations and similarity ratios.  Every function also exists in plain form, so tests
and other Python code can call it.
"""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Mathematical letters; symbols that cannot be said, after folding; operators; marks
#: that may stand inside a word.
VARIABLES = (0x1D400, 0x1D7FF)
UNSAYABLE = re.compile("[\u0370-\u03ff\u2001-\U0010ffff<>|=^_\\\\{}\\[\\]~:]")
INNER_MARKS = frozenset("-.%,'/")
EDGES = ".,;:!?()'\""
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = [(10**9, "billion"), (10**6, "million"), (1000, "thousand"), (100, "hundred")]


def fold(text: str | None) -> str:
    """Compatibility decomposition without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))


def skeleton(token: str | None) -> str:
    """Lower-case ASCII letters and digits of the decomposed token."""
    return re.sub(r"[^a-z0-9]+", "", unicodedata.normalize("NFKD", token or "").lower())


def variable(ch: str) -> bool:
    return VARIABLES[0] <= ord(ch) <= VARIABLES[1]


def exotic(ch: str) -> bool:
    """Not ASCII, and a mathematical letter or no letter that folds to ASCII."""
    if ch.isascii() or variable(ch):
        return not ch.isascii()
    plain = fold(ch)
    return not (plain and plain.isascii() and unicodedata.category(ch)[0] == "L")


def exotic_count(text: str | None) -> int:
    return sum(map(exotic, text or ""))


def repairable(token: str | None) -> bool:
    """A token worth keeping in repaired speech: numbers, and words without mathematical
    letters, operators, doubled glyphs or a quarter of other marks."""
    bare = (token or "").strip(EDGES)
    plain = "" if any(map(variable, bare)) else fold(bare)
    if not plain or UNSAYABLE.search(plain):
        return False
    if not any(map(str.isalpha, plain)):
        return re.fullmatch(r"[-+]?[\d.,%]+", plain) is not None
    if len(plain) > 1 and plain.isalpha() and len(set(plain.lower())) == 1:
        return False
    marks = [c for c in plain if not c.isalnum() and c not in INNER_MARKS]
    return 4 * len(marks) <= len(plain)


def clean_for_speech(text: str | None) -> str:
    """Repairable tokens, folded, with tidy punctuation, no mark in front and an end."""
    out = " ".join(fold(t) for t in (text or "").split() if repairable(t))
    for pattern, to in ((r"\s+([,.;:!?])", r"\1"), (r"([,.;:])(?:\1)+", r"\1"), (r"\(\s*\)", ""), (r"\s+", " ")):
        out = re.sub(pattern, to, out)
    out = out.strip().lstrip(" ,.;:")
    return out if not out or out[-1] in ".?!" else out + "."


def int_words(n: int) -> str:
    if n < 20:
        return ONES[n]
    if n < 100:
        return TENS[n // 10] + (f" {ONES[n % 10]}" if n % 10 else "")
    size, name = next(x for x in SCALES if n >= x[0])
    return f"{int_words(n // size)} {name}" + (f" {int_words(n % size)}" if n % size else "")


def number_words(token: str) -> str:
    """A number as said: years in halves, decimals digit by digit, from 10^12 on every
    digit; a sign is not said.  What is no number stays as it is."""
    whole, point, part = token.lstrip("+-").partition(".")
    if len(token) - len(token.lstrip("+-")) > 1 or not re.fullmatch(r"\d[\d,]*", whole) or point and not re.fullmatch(r"\d+", part):
        return token
    n = int(whole.replace(",", ""))
    if not point and n in range(1100, 2100) and n % 100:
        return f"{int_words(n // 100)} {'oh ' if n % 100 < 10 else ''}{int_words(n % 100)}"
    said = int_words(n) if n < 10**12 else " ".join(ONES[int(d)] for d in str(n))
    return f"{said} point {' '.join(ONES[int(d)] for d in part)}" if point else said


def compare_words(text: str | None, expand: bool = False) -> list[str]:
    plain = re.sub(r"[-/]", " ", fold(text).lower())
    words = [w.strip(".'") for w in re.sub(r"[^a-z0-9'.\s]", " ", plain).split()]
    words = [w for w in words if w]
    return [y for w in words for y in (number_words(w).split() if expand and w[0].isdigit() else [w])]


def edit_operations(source: list[str], heard: list[str]) -> dict:
    """Counts and rates of a matching-blocks comparison without junk words."""
    eq = ins = gone = replaced = new = 0
    missing: list[int] = []
    for tag, i, j, k, n in difflib.SequenceMatcher(None, source, heard, autojunk=False).get_opcodes():
        if tag == "equal":
            eq += j - i
            continue
        missing += range(i, j)
        if tag == "replace":
            replaced, new = replaced + j - i, new + n - k
        else:
            gone, ins = gone + j - i, ins + n - k
    size = max(1, len(source))
    tail = sum(p >= 0.75 * len(source) for p in missing)
    return {
        "eq": eq, "ins": ins, "del": gone, "sub_src": replaced, "sub_asr": new, "ins_rate": round(ins / size, 3), "del_rate": round((gone + replaced) / size, 3),
        "sub_rate": round(replaced / size, 3), "match_rate": round(eq / size, 3), "tail_del_frac": round(tail / max(1, len(missing)), 3),
    }


def aligned(hay: list[str], needle: list[str]) -> list[int | None]:
    """For each needle token the position of its match in the haystack; positions rise.
    Matching blocks with popular needle tokens left out as seeds."""
    out: list[int | None] = [None] * len(needle)
    for block in difflib.SequenceMatcher(None, hay, needle, autojunk=True).get_matching_blocks():
        for k in range(block.size):
            out[block.b + k] = block.a + k
    return out


def dup_coverage(text: str | None, n: int = 4) -> float:
    """Share of the words that lie in a run of ``n`` words occurring more than once, to three
    places; 0 under eight words."""
    words = (text or "").lower().split()
    if len(words) < 8:
        return 0.0
    places: dict[tuple, list[int]] = {}
    for at in range(len(words) - n + 1):
        places.setdefault(tuple(words[at : at + n]), []).append(at)
    covered = {at + k for found in places.values() if len(found) > 1 for at in found for k in range(n)}
    return round(len(covered) / len(words), 3)


def title_words(text: str | None) -> list[str]:
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text or "").casefold())


#: Fixed value: marks of footnotes at the end of a title.
FOOTNOTES = "*∗†‡§¶"


def tidy_title(text: str | None) -> str:
    """One line in composed form: no control characters, no space before closing marks or
    after an opening bracket, no footnote marks at the end."""
    out = re.sub(r"[\x00-\x1f\x7f\s]+", " ", unicodedata.normalize("NFKC", text or "")).strip()
    out = re.sub(r"\s+([,:;?!)])|(\()\s+", lambda m: m[1] or m[2], out)
    return out.rstrip(f" {FOOTNOTES}").strip()


def capitalised(title: str) -> str:
    """First letter of the title and of what follows : ? ! in upper case."""
    return re.sub(r"(\A[^A-Za-z]*|[:?!]\s+)([a-z])", lambda m: m[1] + m[2].upper(), title)


def rejoin(lines: list[str], vocabulary: set[str]) -> str:
    """Wrapped title lines as one.  A line-end hyphen between letters stays, unless the
    joined word is known: then it goes, and the rest goes on in lower case after a
    word that has lower-case letters."""
    out = ""
    for line in map(str.strip, lines):
        cut, rest = re.search(r"([^\W\d_]+)-\Z", out), re.match(r"[^\W\d_]+", line)
        if not (cut and rest):
            out = f"{out} {line}" if out else line
        elif " ".join(title_words(cut[1] + rest[0])) in vocabulary:
            out = out[:-1] + (line if cut[1] == cut[1].upper() else line[0].lower() + line[1:])
        else:
            out += line
    return out


#: Words that stay small inside a title.
SMALL = set("a an and as at but by for from in into nor of on onto or per the to via vs with".split())


def capitals(line: str) -> bool:
    """At least four letters, nine tenths of them upper case."""
    letters = [c for c in line if c.isalpha()]
    return len(letters) >= 4 and 10 * sum(map(str.isupper, letters)) >= 9 * len(letters)


def respelled(line: str, forms: dict[str, dict[str, int]], own: dict[str, int]) -> str:
    """A title line in the spellings that the document uses outside its title (``own``: the
    title's spellings).  Only words all in capitals without digits change: to the most
    frequent spelling with an inner capital; and in a line of capitals to a small word or
    a capitalised one, unless the document knows no other spelling of up to five letters."""
    shouted = capitals(line)

    def one(m: re.Match) -> str:
        word = m[0]
        if word != word.upper() or not word.isupper() or any(map(str.isdigit, word)):
            return word
        known = forms.get(unicodedata.normalize("NFKC", word).casefold(), {})
        outside = {form: n - own.get(form, 0) for form, n in known.items() if n > own.get(form, 0)}
        mixed = {form: n for form, n in outside.items() if not form.isupper() and form[1:] != form[1:].lower()}
        if mixed and len(word) > 2:
            return max(mixed, key=mixed.__getitem__)
        acronym = len(word) <= 5 and outside and all(map(str.isupper, outside))
        if acronym or not shouted:
            return word
        return word.lower() if word.lower() in SMALL else word[0] + word[1:].lower()

    return re.sub(r"[^\W_]+", one, line)


def recased(title: str, forms: dict[str, dict[str, int]]) -> str:
    """A one-line title respelled, its beginnings capitalised if it stood in capitals."""
    own: dict[str, int] = {}
    for w in re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", title)):
        own[w] = own.get(w, 0) + 1
    out = respelled(title, forms, own)
    return capitalised(out) if capitals(title) else out


EDITS = T.StructType([T.StructField(k, T.LongType() if k in ("eq", "ins", "del", "sub_src", "sub_asr") else T.DoubleType()) for k in edit_operations([], [])])


def batched(f: Callable, kind: T.DataType | str):
    """An Arrow-batched UDF of one column."""

    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return x.map(f)

    return run


def register(spark) -> None:
    """The functions under SQL names."""
    for name, f, kind in (("fold", fold, "string"), ("skeleton", skeleton, "string"), ("exotic_count", exotic_count, "int"), ("repairable", repairable, "boolean"), ("clean_for_speech", clean_for_speech, "string"), ("number_words", number_words, "string")):
        spark.udf.register(name, batched(f, kind))


@F.pandas_udf(EDITS)
def edit_summary(source: pd.Series, heard: pd.Series) -> pd.DataFrame:
    rows = [edit_operations(compare_words(a, True), compare_words(b)) for a, b in zip(source, heard)]
    return pd.DataFrame(rows, columns=EDITS.names)


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype=float)
