"""Personal data in free text: places of names, e-mail addresses, phone numbers, identity numbers and addresses.

Bootstrapped contextual extraction.  One scan of the text collects a graph of patterns (the words
beside a candidate) and instances (the candidates).  Spark scores it in rounds:

* names: the seeds are the full names of known people.  A pattern is as good as the share of its
  instances believed; good patterns make unseen pairs and the single parts of names believed,
  which make further patterns good.  Only parts that the graph believes are found in other
  company, with an initial or in another order; of a known person nothing but the full name is
  found without it.
* numbers: the seeds are numbers of a shape that nothing else has (for) and plain numbers of shapes
  that no personal number has (against).  A word that is followed by plain numbers, and by hardly
  any clear ones, counts things: ambiguous numbers behind it are none.  There is no list of
  such words, nor of labels.

The last pass finds every place.

Scale: two scans of the text.  The first counts (pattern, instance) pairs within each batch before
anything is shuffled; plain numbers are counted by pattern alone, so the graph is as large as the
vocabulary of contexts, not as the text.  Each round is written, so lineage doesn't grow.  To the
workers go the parts of names believed, the known people not covered by them and the words found to count things;
their number is checked (``MOST``) and the run stops with an error beyond, it doesn't drop entries.

Defined results: null and empty texts have no places; positions count code points from 1;
repeated rows give repeated places; of overlapping places the longer wins, e-mail before
address, number and name; a text of any length is read whole; an ambiguous number in a context
of which nothing is known is one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import written

ROUNDS = 3
TRUST = 0.8  # confidence of a pattern from which its instances count
BOTH = 2  # edges of trusted patterns that must hold an unseen name, or a part of one
SUPPORT = 5  # edges of a pattern before it counts
COUNTS = 0.02  # a word with a smaller share of clear numbers counts things
REACH = 256  # characters in which the two words before a number are looked for; only whole words count
MOST = 2_000_000  # entries of the lexicon

PLACEHOLDER = {"email": "<EMAIL>", "phone": "<PHONE>", "idnum": "<ID>", "address": "<ADDRESS>", "name": "<NAME>"}

# ---- shapes -----------------------------------------------------------------------------------------------------

_LOCAL = r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_AT = r"(?:\s?[(\[{<]\s?at\s?[)\]}>]\s?)"
_DOT = r"(?:\s?[(\[{<]\s?(?:dot|punkt|point)\s?[)\]}>]\s?)"
EMAIL = re.compile(rf"(?<![\w.%+@-]){_LOCAL}@(?:{_LABEL}\.)+[A-Za-z]{{2,24}}(?![\w-]|\.\w|:[\w~/]|@)")
EMAIL_BRACKETS = re.compile(rf"(?i)(?<![\w.%+@-]){_LOCAL}{_AT}{_LABEL}(?:(?:{_DOT}|\.){_LABEL})+(?![\w-])")
#: Cheap test for a text that may hold one: the end of _AT, in a text in lower case.
_AT_END = re.compile(r"at\s?[)\]}>]")
EMAIL_WORDS = re.compile(rf"(?i)(?<![\w.%+@-]){_LOCAL} at {_LABEL}(?: dot {_LABEL})+(?![\w-])")

PHONE = re.compile(
    r"(?<![\w.+#/-])(?<!\d[ ])(?:"
    r"\+\d{1,3}(?:[ .-]?\(\d{1,5}\))?(?:[ .-]?\d{2,5}){2,5}"
    r"|(?:1[ .-])?\(\d{3}\) ?\d{3}[ .-]\d{4}"
    r"|(?:\d{1,3}[.-])?\d{3}[.-]\d{3}[.-]\d{4}"
    r"|(?:1 )?\d{3} \d{3} \d{4}"
    r"|0\d(?:[ .]\d{2}){4}"
    r"|0\d{2,4}[ /-]\d{5,8}"
    r"|0\d{2,4} \d{3,5} \d{3,4}"
    r")(?![\w]|[-./]\w| \d{2,})"
)
_ID_SHAPES = {
    "ssn": r"\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}",
    "nino": r"[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d]",
    "passport": r"[A-Za-z]\d{8}",
}
IDNUM = re.compile(r"(?<![\w.#/+-])(?<!\d )(?:" + "|".join(f"(?P<{k}>{v})" for k, v in _ID_SHAPES.items()) + r")(?![\w]|[-./]\w| \d)")
#: Shapes that hardly anything else has: the seeds among the numbers.
CLEAR_SHAPES = frozenset(["nino"])


def _clear_phone(number: str) -> bool:
    return number[0] in "+("


_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_UNIT = r"(?i:flat|apt|apartment|unit|suite|ste|room|appt)\.? ?#?\w{1,5}"
_SUFFIX = r"(?i:street|st|avenue|ave|road|rd|lane|ln|drive|dr|court|ct|way|place|pl|boulevard|blvd|terrace|square|sq|close|crescent|row|hill|gardens|parade|parkway|pkwy|highway|hwy)\b\.?"
_TOWN = rf"(?:, (?:\d{{4,6}} )?{_CAP}(?: {_CAP}){{0,2}}(?: \d{{4,6}}(?!\d))?)"
ADDRESS = re.compile(
    rf"(?<![\w.,-])(?:"
    rf"(?:{_UNIT}, ?)?\d{{1,5}}[A-Za-z]? {_CAP}(?: {_CAP}){{0,2}} {_SUFFIX}(?:, ?{_UNIT})?{_TOWN}?"
    rf"|(?:{_UNIT}, ?)?\d{{1,5}}(?: ?bis)?,? (?i:rue|avenue|boulevard|place|chemin|impasse|allée|quai) (?:(?i:de la|de|du|des|de l'|d')\s?)?{_CAP}(?: {_CAP})?{_TOWN}?"
    rf"|(?i:calle|avenida|plaza|paseo|camino|via|viale|piazza|rua) (?:(?i:de la|de|del) )?{_CAP}(?: {_CAP})?,? \d{{1,5}}{_TOWN}?"
    rf"|{_CAP}(?i:straße|strasse|str\.|gasse|weg|platz|allee) \d{{1,5}}[a-z]?{_TOWN}?"
    rf"|(?i:p\. ?o\. box|po box|post box|postfach|apartado|boîte postale) \d{{1,6}}{_TOWN}?"
    rf")"
)
#: Cheap tests for a text that may hold an address: a number before a capital and a kind of street, or a word that stands in one.
_NUMBERED = re.compile(rf"\d[A-Za-z]? {_CAP}(?: {_CAP}){{0,2}} {_SUFFIX}")
_STREETS = (
    "straße", "strasse", "str. ", "gasse ", "weg ", "platz ", "allee ", "allée ", "box ", "postfach ", "apartado ", "postale ", "rue ", "avenue ", "boulevard ", "place ",
    "chemin ", "impasse ", "quai ", "calle ", "avenida ", "plaza ", "paseo ", "camino ", "via ", "viale ", "piazza ", "rua ",
)
#: Cheap test for a text that may hold a personal number: every form has six digits with few signs between, or begins with a plus.
_DIGITS = re.compile(r"\d(?:[ ()./-]{0,3}\d){5}|\+\d")
#: Any number that stands by itself.
_NUMBER = re.compile(r"(?<![\w.,:/@#+-])\d[\d.,:/-]*(?![\w@])")
#: Capitalised words in a row; the last two are the candidate.
_RUN = re.compile(rf"(?<!\w){_CAP}(?:(?:,? (?:[A-Z]\. )?){_CAP})+")
_LAST_TWO = re.compile(rf"{_CAP},? (?:[A-Z]\. )?{_CAP}$")
_AFTER = re.compile(r"[ \t]*([^\w\s]|[\w'’-]+)")


@dataclass
class Lexicon:
    """What the graph decided."""

    given: set[str] = field(default_factory=set)
    family: set[str] = field(default_factory=set)
    people: set[tuple[str, str]] = field(default_factory=set)  # (given, family) known, but with a part that isn't believed
    counting: set[str] = field(default_factory=set)  # one or two words before numbers that are none of a person
    other: set[str] = field(default_factory=set)  # two words that aren't, though the second is


# ---- the graph --------------------------------------------------------------------------------------------------

PAIRS = "kind string, pattern string, instance string, clear boolean, n bigint"
_SOME_DIGITS = re.compile(r"\d+")
_QUOTES = "\"'“”()[]<>*_"


def _word(w: str) -> str:
    """A context word without its numbers and quotes."""
    return w.lower() if w.isalpha() else _SOME_DIGITS.sub("9", w.lower()).strip(_QUOTES)


def _left(text: str, at: int) -> list[str]:
    """Up to two whole words before a place on its line, the nearest last; none if the place follows them without a blank."""
    line = text.rfind("\n", max(0, at - REACH), at) + 1
    from_ = line or max(0, at - REACH)
    if at == from_ or text[at - 1] not in " \t#":
        return []
    words = text[from_:at].rstrip("# \t").split()
    whole = bool(line) or at <= REACH
    return words[-2:] if whole or len(words) > 2 else words[-2:][-(len(words) - 1) :] if len(words) > 1 else []


def contexts(text: str, at: int) -> list[str]:
    """Patterns of a number: two words, then the nearest alone; none without a word of letters."""
    words = [_word(w).rstrip(".:,;=") for w in _left(text, at)]
    if not words or not words[-1].replace("-", "").isalpha():
        return []
    return [" ".join(words), words[-1]] if len(words) > 1 else [words[-1]]


def pairs_of(texts: list[str | None]) -> Counter:
    """(kind, pattern, instance, clear) -> how often."""
    out: Counter = Counter()
    for t in texts:
        if not t:
            continue
        for m in _RUN.finditer(t):
            last = _LAST_TWO.search(m.group())
            if not last:
                continue
            name, at = last.group(), m.start() + last.start()
            before = _left(t, at)
            left = _word(before[-1]) if before else ""
            after = _AFTER.match(t, m.end())
            right = _word(after[1]) if after else ""
            # a pattern needs a word: the one before, or at the start of a line the one after
            if not (any(map(str.isalpha, left)) if left else right.isalpha()):
                continue
            parts = [x.strip(",") for x in name.lower().split() if not (len(x) == 2 and x[1] == ".")]
            out["name", f"{left} _ {right}", " ".join(parts[::-1] if "," in name else parts), False] += 1
        starts = set()
        if _DIGITS.search(t):
            for kind, m in [("phone", m) for m in PHONE.finditer(t)] + [("idnum", m) for m in IDNUM.finditer(t)]:
                starts.add(m.start())
                clear = m.lastgroup in CLEAR_SHAPES if kind == "idnum" else _clear_phone(m.group())
                for p in contexts(t, m.start()):
                    out["number", p, m.group(), clear] += 1
        for m in _NUMBER.finditer(t):
            if m.start() not in starts:
                for p in contexts(t, m.start()):
                    out["plain", p, "", False] += 1
    return out


def count_pairs(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pairs_of(batch.column(0).to_pylist())
            if found:
                cols = [*map(list, zip(*found)), list(found.values())]
                types = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], names=["kind", "pattern", "instance", "clear", "n"])

    return texts.mapInArrow(run, PAIRS).groupBy("kind", "pattern", "instance", "clear").agg(F.sum("n").alias("n"))


def _any_of(trust: Column) -> Column:
    """Belief from several patterns: none of them may be wrong for it to be false."""
    return F.lit(1.0) - F.product(F.lit(1.0) - trust * 0.9)


def score_names(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(role g or f, part) of names that the graph believes after ROUNDS of scoring; seeds: (given, family) of known people."""
    two = F.split("instance", " ")
    edges = pairs.filter("kind = 'name'").select("pattern", two[0].alias("given"), two[1].alias("family"), F.size(two).alias("k")).filter("k = 2").drop("k").distinct()
    known = seeds.select("given", "family").distinct().withColumn("seed", F.lit(True))
    edges = written(edges.join(known, ["given", "family"], "left"), "personal-names")
    pairs_, parts = None, None
    for k in range(ROUNDS):
        df = edges
        if parts is not None:
            for role, name in (("g", "given"), ("f", "family")):
                df = df.join(parts.filter(F.col("role") == role).select(F.col("part").alias(name), F.lit(True).alias(f"__{role}")), name, "left")
            df = df.join(pairs_.withColumn("__p", F.lit(True)), ["given", "family"], "left")
            known_ = F.coalesce(F.col("seed"), F.col("__p"), F.col("__g") & F.col("__f"), F.lit(False))
        else:
            known_ = F.coalesce(F.col("seed"), F.lit(False))
        df = df.select("pattern", "given", "family", "seed", known_.alias("believed"))
        trust = df.groupBy("pattern").agg(F.avg(F.col("believed").cast("double")).alias("trust"), F.count("*").alias("held"))
        trust = trust.filter((F.col("held") >= SUPPORT) & (F.col("trust") >= TRUST * (k + 1) / ROUNDS))
        good = written(df.join(trust.select("pattern", "trust"), "pattern", "left"), "personal-round")
        held = good.filter("trust is not null")
        pairs_ = held.groupBy("given", "family").agg(_any_of(F.col("trust")).alias("belief"), F.count("*").alias("n"))
        pairs_ = pairs_.filter((F.col("n") >= BOTH) & (F.col("belief") >= TRUST)).select("given", "family")
        # a part is as good as the pairs that it stands in: held by trusted patterns, and not mostly in other company
        sure = good.join(pairs_.withColumn("__fresh", F.lit(True)), ["given", "family"], "left").withColumn("sure", F.col("believed") | F.coalesce("__fresh", F.lit(False)))
        each = sure.select("sure", "trust", F.explode(F.array(F.struct(F.lit("g").alias("role"), F.col("given").alias("part")), F.struct(F.lit("f").alias("role"), F.col("family").alias("part")))).alias("e"))
        each = each.groupBy("e.role", "e.part").agg(_any_of(F.when(F.col("sure"), F.coalesce("trust", F.lit(0.0))).otherwise(0.0)).alias("belief"), F.count_if(F.col("sure") & F.col("trust").isNotNull()).alias("n"), F.avg(F.col("sure").cast("double")).alias("share"))
        parts = written(each.filter((F.col("n") >= BOTH) & (F.col("belief") >= TRUST) & (F.col("share") >= 0.5)).select("role", "part"), "personal-parts")
    return parts


def judge_numbers(pairs: DataFrame) -> DataFrame:
    """(pattern, counts): contexts that hold ambiguous numbers, and whether they are found to count things.

    Clear numbers speak for a context, plain ones against it; an ambiguous one speaks for it as far as
    the contexts that hold it are trusted.  A context with little evidence is none that counts.
    """
    numbers = pairs.filter("kind = 'number'").select("pattern", "instance", "clear", "n")
    sure = numbers.filter("clear").groupBy("pattern").agg(F.sum("n").alias("pos"))
    plain = pairs.filter("kind = 'plain'").groupBy("pattern").agg(F.sum("n").alias("neg"))
    unsure = numbers.filter("not clear")
    base = unsure.select("pattern").distinct().join(sure, "pattern", "left").join(plain, "pattern", "left").select("pattern", F.coalesce("pos", F.lit(0)).cast("double").alias("pos"), F.coalesce("neg", F.lit(0)).cast("double").alias("neg"))
    base = written(base, "personal-contexts")
    score = (F.col("pos") + 0.001) / (F.col("pos") + F.col("neg") + 0.01)
    scored = base.select("pattern", "pos", "neg", score.alias("trust"))
    for _ in range(ROUNDS - 1):
        weighed = unsure.join(scored.filter(F.col("pos") + F.col("neg") >= SUPPORT).select("pattern", "trust"), "pattern")
        sums = weighed.groupBy("instance").agg(F.sum(F.col("n") * F.col("trust")).alias("w"), F.sum("n").alias("m"))
        # what a context itself says about its instances doesn't count for it
        own, n = F.coalesce(F.col("n") * F.col("trust"), F.lit(0.0)), F.when(F.col("trust").isNotNull(), F.col("n")).otherwise(0)
        others = unsure.join(scored.filter(F.col("pos") + F.col("neg") >= SUPPORT).select("pattern", "trust"), "pattern", "left").join(sums, "instance")
        more = others.filter(F.col("m") > n).groupBy("pattern").agg(F.sum(F.col("n") * (F.col("w") - own) / (F.col("m") - n)).alias("p"))
        scored = base.join(more, "pattern", "left").select("pattern", (F.col("pos") + F.coalesce("p", F.lit(0.0))).alias("pos"), "neg").select("pattern", "pos", "neg", score.alias("trust"))
    return scored.select("pattern", ((F.col("pos") + F.col("neg") >= SUPPORT) & (F.col("trust") < COUNTS)).alias("counts"), ((F.col("pos") + F.col("neg") >= SUPPORT) & (F.col("trust") >= COUNTS)).alias("personal"))


def full_names(people: list[DataFrame]) -> DataFrame:
    """(given, family) of columns with full names: parts that occur with one partner only (bots, teams) are left out."""
    every = reduce(DataFrame.unionByName, [p.select(p.columns[0]).toDF("full") for p in people])
    parts = F.split(F.lower(F.trim("full")), r"\s+")
    two = every.filter(F.col("full").isNotNull()).select(parts.alias("p")).filter(F.size("p") == 2).select(F.col("p")[0].alias("given"), F.col("p")[1].alias("family")).distinct()
    g = two.groupBy("given").agg(F.count("*").alias("a")).filter("a > 1").select("given")
    f = two.groupBy("family").agg(F.count("*").alias("b")).filter("b > 1").select("family")
    return two.join(g, "given").join(f, "family").select("given", "family")


def learn(texts: DataFrame, people: list[DataFrame]) -> Lexicon:
    """The lexicon from one scan of the texts (column text) and the known people."""
    pairs = written(count_pairs(texts.select("text")), "personal-pairs")
    names = written(full_names(people), "personal-people")
    parts = score_names(pairs, names)
    role = lambda k, as_: parts.filter(F.col("role") == k).select(F.col("part").alias(as_), F.lit(True).alias(f"__{k}"))
    bare = names.join(role("g", "given"), "given", "left").join(role("f", "family"), "family", "left").filter("__g is null or __f is null")
    judged = judge_numbers(pairs)
    one = judged.filter(~F.col("pattern").contains(" ") & F.col("counts")).select(F.col("pattern").alias("last"))
    # of two words only those say more of which the second alone says otherwise
    more = judged.filter(F.col("pattern").contains(" ") & F.col("personal")).withColumn("last", F.substring_index("pattern", " ", -1)).join(one, "last", "left_semi")
    less = judged.filter("counts").withColumn("last", F.when(F.col("pattern").contains(" "), F.substring_index("pattern", " ", -1))).join(one, "last", "left_anti").select("pattern")
    rows = (
        parts.select("role", F.col("part").alias("a"), F.lit("").alias("b")).unionByName(bare.select(F.lit("p").alias("role"), F.col("given").alias("a"), F.col("family").alias("b")))
        .unionByName(less.select(F.lit("n").alias("role"), F.col("pattern").alias("a"), F.lit("").alias("b"))).unionByName(more.select(F.lit("o").alias("role"), F.col("pattern").alias("a"), F.lit("").alias("b")))
        .limit(MOST + 1).collect()
    )
    if len(rows) > MOST:
        raise ValueError(f"the lexicon has more than {MOST} entries; raise MOST and the workers' memory")
    out = Lexicon()
    kept = {"g": out.given, "f": out.family, "n": out.counting, "o": out.other}
    for k, a, b in rows:
        if k == "p":
            out.people.add((a, b))
        else:
            kept[k].add(a)
    return out


# ---- places -----------------------------------------------------------------------------------------------------


class Finder:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon = lexicon
        self.words = None
        alone = {w for p in lexicon.people for w in p}
        if lexicon.given or lexicon.family or alone:
            self.words = ahocorasick.Automaton()
            for w in lexicon.given | lexicon.family | alone:
                self.words.add_word(w, (len(w), (w in lexicon.given) + 2 * (w in lexicon.family)))
            self.words.make_automaton()

    def _personal(self, t: str, at: int) -> bool:
        """Whether an ambiguous number may be one of a person: not behind words that count things."""
        words = contexts(t, at)
        if not words or words[0] in self.lexicon.other:
            return True
        return not any(w in self.lexicon.counting for w in words)

    @staticmethod
    def _edge(t: str, a: int, b: int) -> bool:
        """Whether t[a:b] is a word by itself, no part of a handle or a file."""
        if a and (t[a - 1].isalnum() or t[a - 1] in "_@.+-/\\'’"):
            if not (t[a - 1] in ".'’-" and (a < 2 or t[a - 2] in " \n\t" or (t[a - 1] == "." and a > 1 and not t[a - 2].isalnum()))):
                return False
        if b < len(t):
            c = t[b]
            if c.isalnum() or c in "_@+":
                return False
            if c in ".-'’/\\" and b + 1 < len(t) and t[b + 1].isalnum() and not (c in "'’" and t[b + 1] == "s"):
                return False
        return True

    def names(self, t: str) -> list[tuple[int, int]]:
        if self.words is None:
            return []
        low = t.lower()
        if len(low) != len(t):  # a few letters grow in lower case; keep positions
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in t)
        tokens: list[tuple[int, int, int]] = []
        for end, (size, kind) in self.words.iter(low):
            a, b = end - size + 1, end + 1
            if self._edge(t, a, b):
                while tokens and tokens[-1][0] >= a:  # a longer word ends here
                    tokens.pop()
                tokens.append((a, b, kind))
        out, k, people = [], 0, self.lexicon.people
        while k < len(tokens):
            a, b, kind = tokens[k]
            if k + 1 < len(tokens):
                c, d, other = tokens[k + 1]
                gap = t[b:c]
                turned = (low[c:d], low[a:b]) in people
                pair = (kind & 1 and other & 2) or (kind & 2 and other & 1) or turned or (low[a:b], low[c:d]) in people
                if pair and (
                    re.fullmatch(r"[ \t ]+|[ \t]*\r?\n[ \t]*", gap)
                    or (((kind & 2 and other & 1) or turned) and re.fullmatch(r",[ \t ]*", gap))
                    or re.fullmatch(r"[ \t ]+(?:[^\W\d_]\.?[ \t ]+){1,2}", gap)
                ):
                    rest = re.match(r"[ \t ]+[^\W\d_]\.(?![\w])", t[d : d + 5]) if kind & 2 and "," in gap else None
                    out.append((a, d + (rest.end() if rest else 0)))
                    k += 2
                    continue
            if kind & 2 and (m := re.search(r"(?<![\w.@'’-])(?:[^\W\d_]\.[ \t ]?){1,2}$", t[max(0, a - 8) : a])):
                out.append((max(0, a - 8) + m.start(), b))
            elif m := re.match(r"(?:,[ \t ]?|[ \t ])[A-Z]\.(?![\w])" if kind & 2 else r"[ \t ][A-Za-z]\.(?![\w])", t[b : b + 5]):
                out.append((a, b + m.end()))
            k += 1
        return out

    def places(self, t: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind), from 0, in order, without overlaps."""
        if not t:
            return []
        found: list[tuple[int, int, str]] = []
        if "@" in t:
            found += [(*m.span(), "email") for m in EMAIL.finditer(t)]
        low = t.lower()
        if _AT_END.search(low):
            found += [(*m.span(), "email") for m in EMAIL_BRACKETS.finditer(t)]
        if " dot " in low:
            found += [(*m.span(), "email") for m in EMAIL_WORDS.finditer(t)]
        if any(w in low for w in _STREETS) or _NUMBERED.search(t):
            found += [(*m.span(), "address") for m in ADDRESS.finditer(t)]
        if _DIGITS.search(t):
            found += [(*m.span(), "phone") for m in PHONE.finditer(t) if _clear_phone(m.group()) or self._personal(t, m.start())]
            found += [(*m.span(), "idnum") for m in IDNUM.finditer(t) if m.lastgroup in CLEAR_SHAPES or self._personal(t, m.start())]
        found += [(*s, "name") for s in self.names(t)]
        if len(found) < 2:
            return found
        order = ("email", "address", "phone", "idnum", "name")
        taken: list[tuple[int, int, str]] = []
        for a, b, k in sorted(found, key=lambda x: (order.index(x[2]), x[0] - x[1], x[0])):
            if all(b <= c or a >= d for c, d, _ in taken):
                taken.append((a, b, k))
        return sorted(taken)


_LAST: list = [None, None]


def finder_of(lexicon: Lexicon) -> Finder:
    """The finder of a lexicon, built once in each worker, not in each task: what is broadcast stays the same object there."""
    if _LAST[0] is not lexicon:
        _LAST[:] = [lexicon, Finder(lexicon)]
    return _LAST[1]


def find_places(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """rows: tab, row_key, text -> (tab, row_key, kind, start_pos)."""
    shipped = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = finder_of(shipped.value)
        for batch in batches:
            at, kinds, starts = [], [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                for a, _, k in finder.places(t):
                    at.append(i)
                    kinds.append(k)
                    starts.append(a + 1)
            if at:
                i = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(i), batch.column(1).take(i), pa.array(kinds), pa.array(starts, pa.int64())], names=["tab", "row_key", "kind", "start_pos"])

    return rows.select("tab", "row_key", "text").mapInArrow(run, "tab string, row_key string, kind string, start_pos bigint")


def redact(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """rows with typed placeholders in text, otherwise unchanged."""
    shipped = rows.sparkSession.sparkContext.broadcast(lexicon)

    def cleaned(finder: Finder, t: str | None) -> str | None:
        found = finder.places(t)
        if not found:
            return t
        parts, at = [], 0
        for a, b, k in found:
            parts += [t[at:a], PLACEHOLDER[k]]
            at = b
        return "".join([*parts, t[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = finder_of(shipped.value)
        for batch in batches:
            text = pa.array([cleaned(finder, t) for t in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], names=["tab", "row_key", "text"])

    return rows.select("tab", "row_key", "text").mapInArrow(run, "tab string, row_key string, text string")
