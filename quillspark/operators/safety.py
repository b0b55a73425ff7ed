"""Safety rules over drafts, evidence and queries. Every rule is a Column over folded text, so a batch is one projection."""

from __future__ import annotations

import re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import fold, let, strip

from . import lexicon

MIN_WORDS = 12
CONFIDENCE = 0.35
REPEATS, MIN_SENTENCE = 3, 8


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


_WORD = r"[\p{L}\p{N}_]"


def _automaton(terms: list[str]) -> str:
    """The longest of the terms that ends with a word, as a regular expression in the shape of their trie: a text's character is looked
    at once for all terms that share it."""
    trie: dict = {}
    for t in terms:
        node = trie
        for c in t:
            node = node.setdefault(c, {})
        node[""] = {}

    def told(node: dict) -> str:
        ways = [re.escape(c) + told(rest) for c, rest in node.items() if c]
        if "" in node:
            ways.append(f"(?!{_WORD})")
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return told(trie)


class Matcher:
    """Several word lists as one automaton: a text is passed over once, and every term of every list that it has as whole words is a
    hit; stems don't match longer words. At each word the longest term is found, and the terms that it begins with are hits as well."""

    def __init__(self, lists: dict[str, list[str]]) -> None:
        self.lists = lists
        every = list(dict.fromkeys(t for terms in lists.values() for t in terms))
        self.plain = [t for t in every if re.fullmatch(r"\w(.*\w)?", t, re.S)]
        self.odd = [t for t in every if t not in set(self.plain)]
        self.begins = [(t, p) for t in self.plain for p in self.plain if p != t and re.match(rf"{re.escape(p)}(?!\w)", t)]

    def found(self, folded: Column) -> Column:
        """Distinct terms of all lists that a folded text has."""
        out = F.array().cast("array<string>")
        if self.plain:
            out = F.array_distinct(F.regexp_extract_all(folded, F.lit(f"(?<!{_WORD})(?=({_automaton(self.plain)}))"), F.lit(1)))
        if self.begins:
            pairs = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in self.begins])
            out = let(out, lambda x: F.when(F.size(x) == 0, x).otherwise(F.array_union(x, F.transform(F.filter(pairs, lambda r: F.array_contains(x, r["t"])), lambda r: r["p"]))))
        if self.odd:  # terms that begin or end with a mark
            out = F.concat(out, F.filter(F.lit(self.odd), lambda t: folded.contains(t)))
        return out

    def of(self, found: Column, name: str) -> Column:
        """The hits of one list, in its order."""
        return F.array_intersect(F.lit(self.lists[name]), found) if self.lists[name] else F.array().cast("array<string>")

    def hits(self, folded: Column) -> Column:
        """array<struct<list, ordinal, term>>: every hit with its list and its place there, in the order of the lists."""
        table = F.array(*[F.struct(F.lit(name).alias("list"), F.lit(k).alias("ordinal"), F.lit(t).alias("term")) for name, terms in self.lists.items() for k, t in enumerate(terms)])
        return let(self.found(folded), lambda x: F.filter(table, lambda r: F.array_contains(x, r["term"])))


def terms_in(folded: Column, terms: list[str]) -> Column:
    """Terms that the text has as whole words, in list order; stems don't match longer words."""
    m = Matcher({"terms": terms})
    return m.of(m.found(folded), "terms")


def draft_flags(text: Column | str, min_words: int = MIN_WORDS) -> Column:
    t = strip(F.coalesce(_col(text), F.lit("")))
    few = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda x: x != "")) < min_words
    sentences = F.transform(F.filter(F.split(t, r"[.\n]"), lambda s: F.length(strip(s)) > MIN_SENTENCE), lambda s: F.lower(strip(s)))
    again = let(sentences, lambda all_: (F.size(all_) >= REPEATS) & F.exists(F.array_distinct(all_), lambda s: F.size(F.filter(all_, lambda x: x == s)) >= REPEATS))
    return F.when(t == "", F.array(F.lit("vacio"))).otherwise(F.array_compact(F.array(F.when(few, F.lit("muy_corto")), F.when(again, F.lit("repetitivo")))))


def _joined(evidence: Column | str) -> Column:
    """All evidence texts, folded, one a line."""
    return F.array_join(F.transform(_col(evidence), fold), "\n")


def _unsupported(draft: Column, evidence: Column) -> Column:
    return F.array_sort(F.array_except(draft, evidence))


def unsupported(draft: Column | str, evidence: Column | str, terms: list[str]) -> Column:
    """Terms of the draft that no evidence text has, sorted. evidence: array of texts."""
    return _unsupported(terms_in(fold(draft), terms), terms_in(_joined(evidence), terms))


def _risk_rows(found: Column, table: dict[str, list[str]]) -> Column:
    rows = F.array(*[F.struct(F.lit(t).alias("termino"), F.lit(c).alias("categoria")) for c, ts in table.items() for t in ts])
    return F.filter(rows, lambda r: F.array_contains(found, r["termino"]))


def risk_terms(draft: Column | str, table: dict[str, list[str]] = lexicon.RISK_TERMS) -> Column:
    return let(Matcher(table).found(fold(draft)), lambda x: _risk_rows(x, table))


def _entity_changed(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def entity_changed(draft: Column | str, evidence: Column | str, terms: list[str] = lexicon.CONDITIONS) -> Column:
    """Draft and first evidence both name diagnoses and share none."""
    return let(F.struct(terms_in(fold(draft), terms).alias("d"), terms_in(fold(F.get(_col(evidence), F.lit(0))), terms).alias("e")), lambda x: _entity_changed(x["d"], x["e"]))


def _flag_terms(rules: list) -> dict[str, list[str]]:
    return {sign: list(dict.fromkeys(t for g in groups for t in g)) for sign, groups in rules}


def _red_flags(found: Column, rules: list) -> Column:
    rows = F.array(*[F.struct(F.lit(sign).alias("sign"), F.lit([list(g) for g in groups]).alias("groups")) for sign, groups in rules])
    met = F.filter(rows, lambda r: F.exists(r["groups"], lambda g: F.size(F.array_except(g, found)) == 0))
    return F.when(F.size(found) == 0, F.array().cast("array<string>")).otherwise(F.transform(met, lambda r: r["sign"]))


def red_flags(query: Column | str, rules: list = lexicon.RED_FLAGS) -> Column:
    return let(Matcher(_flag_terms(rules)).found(fold(query)), lambda x: _red_flags(x, rules))


def reassures(draft: Column | str, phrases: list[str] = lexicon.REASSURING) -> Column:
    return F.size(terms_in(fold(draft), phrases)) > 0


def analyze(df: DataFrame, draft: str, evidence: str, query: str | None = None, similarity: str | None = None, confidence: float = CONFIDENCE) -> DataFrame:
    """df with `verdict`: level, flags and findings. Levels: alto, medio, bajo."""
    sim = F.col(similarity).cast("double") if similarity else F.lit(None).cast("double")
    named = {"conditions": lexicon.CONDITIONS, "recommendations": lexicon.RECOMMENDATIONS}
    of_draft = Matcher(named | {"reassuring": lexicon.REASSURING} | lexicon.RISK_TERMS)
    of_evidence, of_query = Matcher(named), Matcher(_flag_terms(lexicon.RED_FLAGS))
    # each text is folded and passed over once, in a projection of its own
    none = F.array().cast("array<string>")
    texts = df.withColumns({"_d": of_draft.found(fold(draft)), "_e": of_evidence.found(_joined(evidence)), "_e1": of_evidence.found(fold(F.get(evidence, F.lit(0)))), "_q": of_query.found(fold(query)) if query else none})
    d, e, q = F.col("_d"), F.col("_e"), F.col("_q")
    of = lambda found, name: of_draft.of(found, name)
    parts = {
        "flags": draft_flags(draft),
        "diagnosticos_no_sustentados": _unsupported(of(d, "conditions"), of(e, "conditions")),
        "recomendaciones_no_sustentadas": _unsupported(of(d, "recommendations"), of(e, "recommendations")),
        "cambio_de_entidad": F.coalesce(_entity_changed(of(d, "conditions"), of(F.col("_e1"), "conditions")), F.lit(False)),
        "banderas_rojas": _red_flags(q, lexicon.RED_FLAGS),
        "terminos_riesgo": _risk_rows(d, lexicon.RISK_TERMS),
        "evidencia_debil": F.coalesce(sim < confidence, F.lit(False)),
        "similitud_max": F.round(sim, 4),
    }
    found = texts.withColumns({f"_{k}": c for k, c in parts.items()})
    found = found.withColumn("_falsa_tranquilizacion", (F.size("_banderas_rojas") > 0) & (F.size(of(d, "reassuring")) > 0))
    some = lambda c: F.size(f"_{c}") > 0
    high = F.array_contains("_flags", "vacio") | some("diagnosticos_no_sustentados") | F.col("_cambio_de_entidad") | some("banderas_rojas") | F.col("_falsa_tranquilizacion") | F.exists("_terminos_riesgo", lambda r: r["categoria"].isin(*lexicon.HIGH_RISK))
    level = F.when(high, "alto").when(some("flags") | some("terminos_riesgo") | some("recomendaciones_no_sustentadas") | F.col("_evidencia_debil"), "medio").otherwise("bajo")
    names = [*parts, "falsa_tranquilizacion"]
    return found.withColumn("verdict", F.struct(level.alias("nivel"), *[F.col(f"_{n}").alias(n) for n in names])).select(*df.columns, "verdict")
