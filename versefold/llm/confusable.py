"""Text that looks the same in other characters (problem 2).

Which characters look alike is the data of the Unicode library (confusables, recommended identifiers) that Spark ships;
which scripts a letter belongs to is its Script_Extensions property, augmented as in UTS 39: Han also stands for the
Chinese, Japanese and Korean writing systems, kana for Japanese, Hangul for Korean, Bopomofo for Chinese.

A text's tokens are runs of letters of alphabetic scripts, and runs of ideographs and kana. For each token the resolved
script sets of its letters are intersected:

* an empty intersection is a mixed-script token. It is spelled in the one script in which all (or, failing that, most) of
  its letters have a form, Latin first; letters that have none stay.
* a token of one script, not Latin, whose letters all look like plain Latin ones is a whole-script confusable, unless it
  stands beside a genuine word of its script. It is spelled in Latin.
* a kana that looks like an ideograph, in a run of ideographs whose text holds no kana of another form, becomes that
  ideograph; an ideograph that looks like a katakana, between two katakana of other forms, becomes that katakana.

Beside this, full-width and font variants of letters and digits, radicals and compatibility ideographs get their ordinary
characters, small capitals and odd Latin letters (script g, dotless i) their plain ones, every other space becomes a
space, invisible characters go (joiners within emoji and within scripts that need them stay), and accents are composed.

Left alone: ordinary Chinese punctuation, full-width punctuation, Traditional characters, composed accents, emoji
sequences, words wholly in another script. Null stays null; empty and blank texts of ordinary blanks stay as they are.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters that are Latin themselves, and the ordinary character that they look like; and look-alikes of
# Latin letters that the Unicode data has at a distance of more than one step.
LATIN_ODD = "ɑɡıȷſꞌǃĸ"
LATIN_PLAIN = "agijs'!k"
EXTRA = {"ԍ": "g", "Լ": "L"}

#: Scripts that a token may mix with none but themselves, by UTS 39's augmented sets.
WRITING = {"Hani": {"Hani", "Hanb", "Jpan", "Kore"}, "Hira": {"Hira", "Jpan"}, "Kana": {"Kana", "Jpan"}, "Hang": {"Hang", "Kore"}, "Bopo": {"Bopo", "Hanb"}}
_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Bopomofo}\p{scx=Hiragana}\p{scx=Katakana}"
TOKEN = regex.compile(rf"(?:(?=\p{{L}})[^{_CJK}]\p{{M}}*)+")
ODD_LETTER = regex.compile(rf"(?=\p{{L}})[^\p{{Latin}}{_CJK}]|[ᴀ-ᴢꜰꜱɢɪɴʀʏʙʜʟ]")
KANA = regex.compile(r"[\p{scx=Katakana}\p{scx=Hiragana}&&[\p{L}\p{Lm}]]", regex.V1)
_SCRIPTS = "Latn Grek Cyrl Armn Hebr Arab Syrc Thaa Deva Beng Guru Gujr Orya Taml Telu Knda Mlym Sinh Thai Laoo Tibt Mymr Geor Hang Ethi Cher Cans Ogam Runr Khmr Mong Hira Kana Bopo Hani Yiii Ital Goth Copt Glag Tfng Lisu Vaii Bamu Osma Dsrt Cprt Linb Lyci Cari Lydi Phnx Tale Talu Limb Nkoo Olck Saur Kali Tglg Buhd Tagb Hano Bugi Bali Sund Batk Lepc Java Cham Mtei Lana Tavt Cakm Osge Adlm Wara Medf Rohg Hmnp Plrd".split()


def _script_patterns() -> list[tuple[str, regex.Pattern]]:
    out = []
    for s in _SCRIPTS:
        try:
            out.append((s, regex.compile(rf"\p{{scx={s}}}")))
        except regex.error:  # a script that this Unicode version does not know
            continue
    return out


_PATTERNS = _script_patterns()


@lru_cache(maxsize=100_000)
def scripts(ch: str) -> frozenset[str]:
    """The augmented script set of a letter; of Common and Inherited characters the empty set, which stands for all."""
    found = {s for s, p in _PATTERNS if p.match(ch)}
    return frozenset(found.union(*[WRITING.get(s, ()) for s in found])) if found else frozenset()


class LookAlikes:
    """Letters by what they look like: `skeletons` are pairs of a letter and its skeleton, `plain` all recommended characters."""

    def __init__(self, skeletons: dict[str, str], recommended: frozenset[str]):
        self.skeleton = skeletons
        self.classes: dict[str, list[str]] = defaultdict(list)
        for c, k in skeletons.items():
            self.classes[k].append(c)
        for k in list(self.classes):
            self.classes[k] = sorted({*self.classes[k], *([k] if len(k) == 1 else [])})
        self.recommended = recommended
        self.known: dict[tuple[str, str], str | None] = {}

    def alike(self, ch: str) -> list[str]:
        return self.classes.get(self.skeleton.get(ch, ch), [])

    def spelled(self, ch: str, script: str) -> str | None:
        """The letter of this script that looks like ch: recommended ones first, then of the same case, then the first."""
        key = (ch, script)
        if key not in self.known:
            if not scripts(ch) or script in scripts(ch):
                self.known[key] = ch
            else:
                kind = unicodedata.category(ch)
                forms = [x for x in self.alike(ch) if script in scripts(x) and unicodedata.category(x)[0] == "L"]
                if script == "Latn":
                    forms = [f for x in forms if (f := ordinary(x)) in _ASCII] + ([EXTRA[ch]] if ch in EXTRA else [])
                self.known[key] = min(forms, key=lambda x: (x not in self.recommended, unicodedata.category(x) != kind, x), default=None)
        return self.known[key]

    @lru_cache(maxsize=100_000)  # noqa: B019
    def plain_latin(self, ch: str) -> bool:
        """Whether a letter of another script looks, without any step between, like an ASCII letter of its case."""
        return ODD.get(self.skeleton.get(ch, ch)) == "k" or ch in EXTRA or any(x in _ASCII and unicodedata.category(x) == unicodedata.category(ch) for x in self.alike(ch))


_ASCII = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_KNOWN: dict[str, LookAlikes] = {}
_SHARED: dict[str, object] = {}


def look_alikes(spark: SparkSession) -> tuple[dict[str, str], frozenset[str]]:
    """Skeletons of all letters whose skeleton is one character, and the recommended ones among them: asked once of the JVM.

    Some ten thousand entries, whose number Unicode fixes. Ideographs stand in it only beside the kana that look like them.
    """
    jvm = spark.sparkContext._jvm.com.ibm.icu
    chars = [chr(c) for c in range(0x41, 0x20000) if unicodedata.category(chr(c))[0] == "L" and not 0xAC00 <= c <= 0xD7A3]
    forms = jvm.text.SpoofChecker.Builder().build().getSkeleton(0, "\n".join(chars)).split("\n")
    if len(forms) != len(chars):
        raise ValueError("skeletons do not keep lines")
    out = {c: k for c, k in zip(chars, forms) if len(k) == 1 and len(unicodedata.normalize("NFD", c)) == 1}
    size: Counter[str] = Counter(out.values())
    out = {c: k for c, k in out.items() if size[k] > 1}
    named = jvm.text.UnicodeSet().addAll("".join({*out, *out.values()})).retainAll(jvm.text.SpoofChecker.RECOMMENDED)
    ranges = [(named.getRangeStart(i), named.getRangeEnd(i)) for i in range(named.getRangeCount())]
    return out, frozenset(chr(c) for a, b in ranges for c in range(a, b + 1))


def shared(spark: SparkSession):
    """The look-alikes as a broadcast value, for `installed`; also made known to this process."""
    app = spark.sparkContext.applicationId
    if app not in _SHARED:
        _SHARED[app] = spark.sparkContext.broadcast(look_alikes(spark))
    installed(_SHARED[app])
    return _SHARED[app]


def installed(value) -> LookAlikes:
    """This process's look-alikes, made once from the broadcast value."""
    if "all" not in _KNOWN:
        _KNOWN["all"] = LookAlikes(*value.value)
    return _KNOWN["all"]


EMOJI = regex.compile(r"[\p{Extended_Pictographic}\p{Emoji_Modifier}\p{Regional_Indicator}️⃣]")
JOINING = regex.compile(r"[\p{Arabic}\p{Syriac}\p{Mongolian}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Khmer}\p{Tibetan}\p{Myanmar}]")
#: Cells without any character of this class are surely in their consistent form; tested in the JVM.
ODD_CLASS = "[^\\t\\n\\r -~\\u4e00-\\u9fff\\u3400-\\u4dbf\\u3001\\u3002\\uff01\\uff08\\uff09\\uff0c\\uff1a\\uff1b\\uff1f\\u300a-\\u3011\\u3014\\u3015\\u2014\\u2026\\u00b7\\u2018-\\u201d]"

ODD_CELL = regex.compile(ODD_CLASS)


ODD = dict(zip(LATIN_ODD, LATIN_PLAIN))


@lru_cache(maxsize=4096)
def small_capital(ch: str) -> str | None:
    """The plain letter of a Latin small capital, by its name."""
    name = unicodedata.name(ch, "")
    plain = name.removeprefix("LATIN LETTER SMALL CAPITAL ")
    return plain.lower() if plain != name and len(plain) == 1 else None


@lru_cache(maxsize=100_000)
def ordinary(ch: str) -> str:
    """The ordinary form of one character, without regard to its neighbours."""
    kind = unicodedata.category(ch)
    if ch < "\x7f":
        return ch
    if kind == "Zs":
        return " "
    form = unicodedata.decomposition(ch)
    tag = form.split(" ")[0] if form.startswith("<") else ""
    if tag in ("<wide>", "<font>", "<narrow>") and (kind[0] in "LN" or tag != "<wide>"):
        return unicodedata.normalize("NFKC", ch)
    if "⺀" <= ch <= "⿟" and tag == "<compat>":
        return unicodedata.normalize("NFKC", ch)
    if ch == "‑":
        return "-"
    return ODD.get(ch) or small_capital(ch) or ch


def invisible(ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" or ch in "͏ᅟᅠ឴឵ㅤﾠ" or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef"


def _belongs(text: str, i: int) -> bool:
    """Whether an invisible character has its place between its neighbours."""
    ch, left, right = text[i], text[i - 1 : i] if i else "", text[i + 1 : i + 2]
    if ch == "‍":
        return bool(left and right) and bool(EMOJI.match(left) and EMOJI.match(right) or JOINING.match(left) and JOINING.match(right))
    if ch == "‌":
        return bool(left and right and JOINING.match(left) and JOINING.match(right))
    if "︀" <= ch <= "️":
        return bool(left) and bool(regex.match(r"[\p{So}\p{Sm}\p{Extended_Pictographic}\d#*]", left))
    if "\U000e0020" <= ch <= "\U000e007f":
        return bool(left) and (left == "\U0001f3f4" or "\U000e0020" <= left <= "\U000e007f")
    return "؀" <= ch <= "۝"


def _letters(token: str) -> list[str]:
    return [c for c in token if not unicodedata.category(c).startswith("M")]


def resolved(letters: list[str]) -> frozenset[str] | None:
    """The intersection of the letters' script sets; None stands for all scripts, the empty set for a mixture."""
    out: frozenset[str] | None = None
    for c in letters:
        if s := scripts(c):
            out = s if out is None else out & s
    return out


def spell(token: str, foreign_context: bool, look: LookAlikes) -> str:
    """The token (decomposed) in its consistent script."""
    letters = _letters(token)
    common = resolved(letters)
    if common is None or "Latn" in common:
        return token
    if common:  # of one script: disguised only if every letter has a plain Latin look-alike
        if foreign_context or not all(look.plain_latin(c) and look.spelled(c, "Latn") for c in letters):
            return token
        target = "Latn"
    else:
        own = Counter(s for c in letters for s in scripts(c))
        target = max(sorted({"Latn", *own}), key=lambda to: (sum(look.spelled(c, to) is not None for c in letters), to == "Latn", own[to]))
    return "".join(look.spelled(c, target) or c if c in letters else c for c in token)


def _ideographs(text: str, look: LookAlikes) -> str:
    """Kana that stand for ideographs, and ideographs that stand for katakana; see the module's text."""
    kana = [m.start() for m in KANA.finditer(text)]
    as_han = {i: look.spelled(text[i], "Hani") for i in kana}
    genuine = {i for i in kana if as_han[i] is None and text[i] != "ー"}
    out = list(text)
    if not genuine:
        if any("Hani" in scripts(c) and c not in look.skeleton for c in text):
            for i in kana:
                near = text[max(0, i - 1) : i] + text[i + 1 : i + 2]
                if as_han[i] and any("Hani" in scripts(c) for c in near):
                    out[i] = as_han[i]
    else:
        for i in range(1, len(text) - 1):
            if i - 1 in genuine and i + 1 in genuine and "Hani" in scripts(text[i]) and text[i] in look.skeleton:
                out[i] = look.spelled(text[i], "Kana") or text[i]
    return "".join(out)


def consistent(text: str | None, look: LookAlikes | None = None) -> str | None:
    """One consistent form of a text. look: if it is not given, what `shared` or `installed` made known to this process."""
    if not text or not ODD_CELL.search(text):
        return text
    look = look or _KNOWN["all"]
    chars = [ordinary(c) for i, c in enumerate(text) if not (c > "~" and invisible(c)) or _belongs(text, i)]
    s = unicodedata.normalize("NFD", "".join(chars))
    if KANA.search(s):
        s = _ideographs(unicodedata.normalize("NFC", s), look)
        s = unicodedata.normalize("NFD", s)
    if ODD_LETTER.search(s):
        found = list(TOKEN.finditer(s))
        words = [m.group() for m in found]
        common = [resolved(_letters(w)) for w in words]
        genuine = [bool(c) and "Latn" not in c and not all(look.plain_latin(x) for x in _letters(w)) for w, c in zip(words, common)]

        def beside(i: int) -> bool:
            for k in (i - 1, i + 1):
                if 0 <= k < len(found) and genuine[k] and common[i] and common[k] & common[i]:
                    a, b = sorted((i, k))
                    if not s[found[a].end() : found[b].start()].strip(" ,.-'’"):
                        return True
            return False

        out, at = [], 0
        for i, m in enumerate(found):
            out += [s[at : m.start()], words[i] if genuine[i] else spell(words[i], beside(i), look)]
            at = m.end()
        s = "".join([*out, s[at:]])
    return unicodedata.normalize("NFC", s)


def consistent_column(c: Column, spark: SparkSession) -> Column:
    """Only cells with an unusual character go to Python; all others are passed through in the JVM."""
    value = shared(spark)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        look = installed(value)
        return pd.Series([consistent(x, look) for x in s], dtype=object)

    return F.when(c.rlike(ODD_CLASS), run(F.when(c.rlike(ODD_CLASS), c))).otherwise(c)


def normalized(df: DataFrame, table_name: str, key: str, field: str) -> DataFrame:
    """table_name, row_key, field_name, original, normalized: of every row of a table."""
    return df.select(
        F.lit(table_name).alias("table_name"), F.col(f"`{key}`").cast("string").alias("row_key"), F.lit(field).alias("field_name"),
        F.col(f"`{field}`").alias("original"), consistent_column(F.col(f"`{field}`"), df.sparkSession).alias("normalized"),
    )


def disguised(df: DataFrame, table_name: str, key: str, field: str) -> DataFrame:
    """The rows of `normalized` whose cell had a character out of place; cells that cannot are left out before Python."""
    return normalized(df.where(F.col(f"`{field}`").rlike(ODD_CLASS)), table_name, key, field).where("original <> normalized")
