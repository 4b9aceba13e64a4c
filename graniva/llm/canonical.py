"""Mapping of freely typed values to the entries of a reference list."""

from __future__ import annotations

import re
import unicodedata
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniva.plans.stage import materialize

#: Names of one block of the reference list; larger lists are searched block by block, with the same answers.
BLOCK_NAMES = 50_000
#: Default words that set places apart (Port X isn't X), besides those that the reference list itself shows, and words around a place that don't.
PLACE_LEADS = ("north", "south", "east", "west", "new", "port", "fort", "mount", "lake", "saint", "upper", "lower", "falls")
PLACE_AROUND = ("near", "downtown", "greater", "city", "of", "the", "town", "central", "metro", "area", "in", "at")
#: Short forms that aren't made of the letters of their word.
PLACE_SHORT = {"ste": "saint"}

# Letters that look like Latin ones, upper then lower case.
_LOOKS = str.maketrans("АВЕКМНОРСТУХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧавекмнорстухіјѕһԁοαινρκτυ", "ABEKMHOPCTYXIJSABEZHIKMNOPTYXabekmhopctyxijshdoaivpktu")
# Letters that a digit may have been typed for.
_DIGITS = {"0": "o", "1": "li", "3": "e", "4": "a", "5": "s", "7": "t"}


def words(value: str) -> list[str]:
    """Words of a value without marks and case, look-alike letters as Latin ones; digits stay."""
    v = unicodedata.normalize("NFKD", value.translate(_LOOKS)).casefold().translate(_LOOKS)
    return re.findall(r"[^\W_]+", "".join(c for c in v if not unicodedata.combining(c)))


def _edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours; ``most + 1`` where it is larger than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def shortens(short: str, word: str) -> float:
    """How well ``short`` abbreviates ``word``: 0.95 for its beginning or a contraction to its last letter, 0.9 for other letters in order, else 0."""
    if not short or len(short) >= len(word) or len(short) > 3 or short[0] != word[0]:
        return 0.0
    rest = iter(word)
    if not all(c in rest for c in short):
        return 0.0
    return 0.95 if word.startswith(short) or (len(short) > 1 and short[-1] == word[-1]) else 0.9


def shared_words(names: list[str]) -> tuple[set[str], set[str]]:
    """Words of several words' names, once for each name, and the words of names that could be taken for codes or numbers (two characters, or digits)."""
    several, odd = set(), set()
    for n in names:
        own = words(n)
        several |= set(own) if len(own) > 1 else set()
        odd |= {w for w in own if len(w) <= 2 or w.isdigit()}
    return several, odd


class Matcher:
    """Finds the entry that a value names.

    An automaton over all names and aliases is run over the value without spaces; of its matches the longest
    non-overlapping ones count, and one entry is named when only words of ``around``, codes of two letters and numbers that
    no name contains surround it. Remaining values are compared as sets of words with the entries that share an
    unbroken piece of a word with them: words count as equal within ``edits`` edits and a quarter of their length,
    words that set entries apart (``leads``) also in short forms; a lead on one side only is a
    contradiction. Words run together are compared as one. An entry needs a similarity of ``least``.
    """

    def __init__(self, names: list[tuple[int, str]], edits: int = 3, leads: set[str] | None = None, kept: set[str] | None = None, around: tuple[str, ...] = PLACE_AROUND, short: dict[str, str] | None = None, least: float = 0.6):
        import ahocorasick

        self.short = PLACE_SHORT if short is None else short
        self.edits, self.least, self.around = edits, least, sorted(around, key=len, reverse=True)
        if leads is None or kept is None:
            leads, kept = _evidence([n for _, n in names], PLACE_LEADS, around)
        self.leads, self.kept = leads, kept
        self.forms: dict[str, list[tuple[int, str]]] = {}
        self.sets: dict[tuple[str, ...], set[int]] = {}
        pieces: dict[str, set[tuple[str, ...]]] = {}
        self.full, self.parts = ahocorasick.Automaton(), ahocorasick.Automaton()
        for i, n in names:
            own = words(n)
            if not own:
                continue
            self.forms.setdefault("".join(own), []).append((i, n.casefold().strip()))
            entry = tuple(own)
            self.sets.setdefault(entry, set()).add(i)
            for w in {*self._telling(own), "".join(own)}:
                k = self._allowed(w) + 1
                cut = [round(j * len(w) / k) for j in range(k + 1)]
                for a, b in zip(cut, cut[1:]):
                    pieces.setdefault(w[a:b], set()).add(entry)
        for form in self.forms:
            self.full.add_word(form, form)
        for piece, entries in pieces.items():
            self.parts.add_word(piece, entries)
        for a in (self.full, self.parts):
            if len(a):
                a.make_automaton()

    def _allowed(self, word: str) -> int:
        return max(0, min(self.edits, len(word) // 4))

    def _telling(self, own) -> list[str]:
        """Words of an entry that tell it from others; all, where it has leads alone."""
        return [w for w in own if w not in self.leads and w not in self.around] or list(own)

    def _readings(self, value: str) -> list[list[str]]:
        """Words of the value with digits inside words read as letters, in every way where there are few."""
        options, ways = [], 1
        for w in words(value):
            if w in self.kept or not any(c.isdigit() for c in w):
                options.append([w])
                continue
            w = re.sub(r"\d{4,}$", "", w)  # a number run together with a word
            if w.isdigit() or not w:
                continue
            letters = [_DIGITS.get(c, c) for c in w]
            n = 1
            for x in letters:
                n *= len(x)
            own = ["".join(p) for p in product(*letters)] if n * ways <= 16 else ["".join(x[0] for x in letters), "".join(x[-1] for x in letters)]
            options.append(own)
            ways *= len(own)
        return [list(p) for p in product(*options)] if ways <= 64 else [[o[0] for o in options]]

    def _code(self, w: str) -> bool:
        return len(w) <= 2 and w not in self.kept

    def _short_lead(self, w: str) -> bool:
        return any(self._shortens(w, x) for x in self.leads)

    def _shortens(self, short: str, word: str) -> float:
        return 0.95 if self.short.get(short) == word else shortens(short, word)

    def _plain(self, text: str) -> bool:
        """Whether a piece of joined text consists of words around a place."""
        while text:
            word = next((w for w in self.around if text.startswith(w)), None)
            if word is None:
                return False
            text = text[len(word) :]
        return True

    def __call__(self, value: str) -> tuple[int, float]:
        """The entry named by ``value`` (0: none) and the similarity of the match."""
        _, similarity, i = self.best(value)
        return (i, similarity) if i else (0, 0.0)

    def best(self, value: str) -> tuple[int, float, int]:
        """(length of an embedded mention or 0, similarity, entry or 0) of the best match; equally good ones of several entries give the entry 0."""
        found = [self._read(own, value) for own in self._readings(value) if own]
        return decided(found)

    def _read(self, own: list[str], value: str) -> tuple[int, float, int]:
        return self._mention(own, value) or self._similar(own)

    def _mention(self, own: list[str], value: str) -> tuple[int, float, int] | None:
        if not len(self.full):
            return None
        text, owner = "".join(own), [k for k, w in enumerate(own) for _ in w]
        hits = sorted(((e - len(f) + 1, e + 1, f) for e, f in self.full.iter(text)), key=lambda h: (h[0] - h[1], h[0]))
        taken: list[tuple[int, int, str]] = []
        for h in hits:
            if all(h[1] <= t[0] or h[0] >= t[1] for t in taken):
                taken.append(h)
        if len({f for *_, f in taken}) != 1:
            return None
        covered = {c for a, b, _ in taken for c in range(a, b)}
        first, rest = min(owner[a] for a, *_ in taken), {}
        for c, k in enumerate(owner):
            if c not in covered:
                rest.setdefault(k, []).append(text[c])
        touched = {owner[c] for c in covered}
        for k, letters in rest.items():
            w = "".join(letters)
            if k not in touched and self._code(w) and not (k < first and self._short_lead(w)):
                if any(self._shortens(w, x) and self._joined(x, taken[0][2]) for x in self.leads):
                    return None
                continue
            if not self._plain(w):
                return None
        form = taken[0][2]
        named = self.forms[form]
        same = [i for i, n in named if n == value.casefold().strip()] or [i for i, n in named if len({m for _, m in named}) == 1]
        ids = {i for i, _ in named}
        return len(form), 1.0, min(same) if same else ids.pop() if len(ids) == 1 else 0

    def _joined(self, lead: str, form: str) -> bool:
        return lead + form in self.forms or form + lead in self.forms

    def _similar(self, own: list[str]) -> tuple[int, float, int]:
        """The best entry by the similarity of word sets, or of the words as one where they were run together."""
        text = "".join(own)
        entries = set().union(*(e for _, e in self.parts.iter(text))) if len(self.parts) else set()
        rest = [w for w in own if w not in self.around and not (self._code(w) and not self._short_lead(w))] or own
        found = []
        for entry in entries:
            s = max(self._sets(own, entry), self._run_together(rest, own, entry))
            if s >= self.least:
                ids = self.sets[entry]
                found.append((0, s, min(ids)))
        return decided(found)

    def _equal(self, typed: str, word: str) -> float:
        """Similarity of a typed word with a word of an entry; 0 if they aren't taken for the same."""
        if typed == word:
            return 1.0
        if typed in self.leads:
            return 0.0
        short = self._shortens(typed, word) if word in self.leads else 0.0
        d = _edits(typed, word, self._allowed(word))
        near = 1 - d / len(word) if d <= self._allowed(word) else 0.0
        return max(short, near)

    def _sets(self, own: list[str], entry: tuple[str, ...]) -> float:
        pairs = sorted(((self._equal(t, w), -abs(i - j), i, j) for i, t in enumerate(own) for j, w in enumerate(entry)), reverse=True)
        left, right, match = {}, {}, 0.0
        for s, _, i, j in pairs:
            if s > 0 and i not in left and j not in right:
                left[i], right[j] = s, s
                match += s * len(entry[j])
        telling = self._telling(entry)
        if any(w in self.leads and j not in right for j, w in enumerate(entry) if w not in telling):
            return 0.0
        if sum(len(w) for j, w in enumerate(entry) if w in telling and j in right) < self.least * sum(map(len, telling)):
            return 0.0
        start, extra = min(left, default=0), 0
        for i, t in enumerate(own):
            if i in left or t in self.around:
                continue
            lead = t in self.leads or any(self._near_lead(t, x) or (i < start and self._shortens(t, x)) for x in self.leads)
            if lead:
                return 0.0
            extra += 0 if self._code(t) and not self._short_lead(t) else len(t)
        return match / (sum(map(len, entry)) + extra)

    def _near_lead(self, typed: str, lead: str) -> bool:
        return len(typed) > 3 and typed not in self.kept and _edits(typed, lead, self._allowed(lead)) <= self._allowed(lead)

    def _run_together(self, rest: list[str], own: list[str], entry: tuple[str, ...]) -> float:
        """Similarity of the joined words, also without words around a place at the beginning; leads typed as words must be the entry's."""
        if {w for w in own if w in self.leads} - set(entry):
            return 0.0
        form, best = "".join(entry), 0.0
        most = self._allowed(form)
        texts = {"".join(rest), "".join(own)}
        for text in list(texts):
            texts |= {text[len(w) :] for w in self.around if text.startswith(w) and len(text) > len(w) + 5}
        for text in texts:
            d = _edits(text, form, most)
            if d <= most and text:
                best = max(best, 1 - d / len(form))
        return best


def decided(found: list[tuple[int, float, int]]) -> tuple[int, float, int]:
    """The best of matches (mention, similarity, entry); entry 0 where the best ones name several."""
    if not found:
        return 0, 0.0, 0
    top = max((m, round(s, 9)) for m, s, _ in found)
    ids = {i for m, s, i in found if (m, round(s, 9)) == top}
    return top[0], top[1], ids.pop() if len(ids) == 1 else 0


def _evidence(names: list[str], leads: tuple[str, ...], around: tuple[str, ...]) -> tuple[set[str], set[str]]:
    """Leads: the given ones and words that several names of more than one word share; and the words of names that look like codes or numbers."""
    count: dict[str, int] = {}
    kept: set[str] = set()
    for n in set(names):
        several, odd = shared_words([n])
        kept |= odd
        for w in several:
            count[w] = count.get(w, 0) + 1
    return ({w for w, n in count.items() if n > 1} | set(leads)) - set(around), kept


def map_to_reference(df: DataFrame, value: str, ref: DataFrame, ref_id: str, name: str, others: str | None = None, edits: int = 3, block: int = BLOCK_NAMES, leads: tuple[str, ...] = PLACE_LEADS, around: tuple[str, ...] = PLACE_AROUND, short: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``ref_id`` (0: names no entry; null: null or blank value) and ``match_similarity``.

    Each distinct value is matched once (:class:`Matcher`). Reference lists of more than ``block`` names are searched in
    blocks; the best match of all blocks counts, equally good matches of several entries name none, and what the list shows about its
    words comes from the whole list, so the blocks don't change an answer. Null names and aliases are ignored; of equal names the
    smallest id counts. An empty list maps every value to 0; columns of ``df`` named like the new ones are replaced.
    """
    spark = df.sparkSession
    df = df.drop(ref_id, "match_similarity")
    names = F.array(F.col(name))
    if others:
        names = F.concat(names, F.coalesce(F.col(others), F.array().cast("array<string>")))
    listed = ref.select(F.col(ref_id).cast("long").alias("id"), F.explode(names).alias("name")).dropna().groupBy("name").agg(F.min("id").alias("id"))
    listed = materialize(listed, "reference")
    blocks = max(1, -(-listed.count() // block))
    typed = F.col(value)
    blank = typed.isNull() | typed.rlike(r"^[\s\x85\xa0  -   　]*$")
    distinct = materialize(df.filter(~blank).select(typed.alias("__value")).distinct(), "values")
    n = distinct.count()
    salts = max(-(-n // 100_000), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 500)), 1)

    def split(batches):
        for pdf in batches:
            rows = [(w, kind) for x in pdf["name"] for kind, own in enumerate(shared_words([x])) for w in own]
            yield pd.DataFrame(rows, columns=["word", "kind"])

    # words that repeat over the names of the list: bounded by its vocabulary
    seen = listed.select("name").mapInPandas(split, "word string, kind int").groupBy("word", "kind").agg(F.count("*").alias("n")).filter("kind = 1 OR n > 1").collect()
    known = ({r[0] for r in seen if r[1] == 0} | set(leads)) - set(around)
    kept = {r[0] for r in seen if r[1] == 1}

    def run(values: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        match = Matcher(sorted(zip(rows["id"], rows["name"])), edits, known, kept, around, short)
        hits = [match.best(v) for v in values["__value"]]
        return pd.DataFrame({"__value": values["__value"], "m": [h[0] for h in hits], "s": [h[1] for h in hits], "id": [h[2] for h in hits]})

    salt = F.pmod(F.xxhash64("__value"), F.lit(salts)).cast("int").alias("salt")
    left = distinct.select("__value", salt, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = listed.select("id", "name", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    found = left.groupBy("block", "salt").cogroup(right.groupBy("block", "salt")).applyInPandas(run, "__value string, m int, s double, id long")
    best = found.groupBy("__value").agg(F.max(F.struct("m", F.round("s", 9).alias("s"))).alias("b"), F.collect_list(F.struct("m", F.round("s", 9).alias("s"), "id")).alias("all"))  # one for each block
    ids = F.array_distinct(F.transform(F.filter("all", lambda x: (x["m"] == F.col("b.m")) & (x["s"] == F.col("b.s"))), lambda x: x["id"]))
    one = F.when(F.size(ids) == 1, ids[0]).otherwise(F.lit(0))
    found = best.select("__value", one.alias("__id"), F.when(one > 0, F.col("b.s")).otherwise(0.0).alias("__s"))
    found = materialize(found, "matches")
    out = df.withColumn("__value", F.when(~blank, typed)).join(found, "__value", "left").drop("__value")
    return out.withColumnsRenamed({"__id": ref_id, "__s": "match_similarity"})


def map_cities(business: DataFrame, city_ref: DataFrame) -> DataFrame:
    """(business_id, city, city_id, match_similarity) of the businesses whose city isn't blank."""
    rows = business.select("business_id", "city").distinct()
    return map_to_reference(rows, "city", city_ref, "city_id", "city", "other_names").filter("city_id is not null")
