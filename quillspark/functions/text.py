"""Scalar text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Answer columns in order of preference.
ANSWER_COLUMNS = ("synthesized_answer_es", "answer_es")

# Fixed values that results depend on.
GENERIC_MARKERS = ["consulte a un dermatólogo", "consulta con un dermatólogo", "no puedo diagnosticar", "no se puede determinar", "la imagen no es clara"]
VARIANT_ALIASES = {"longest_answer": "dataset_longest_answer", "dataset_longest_answer": "dataset_longest_answer", "enriched": "dataset_enriched", "llm_synthesized_answer": "dataset_enriched", "dataset_enriched": "dataset_enriched"}
SPLIT_LABELS = {"valid_ht": "valid", "test_ht_spanishtestsetcorrected": "test"}
METHOD_LABELS = {
    "retrieval_tfidf": "TF-IDF",
    "retrieval_e5": "E5",
    "retrieval_sbert": "SBERT",
    "retrieval_textual_tfidf": "TF-IDF",
    "retrieval_textual_e5": "E5",
    "retrieval_textual_sbert": "SBERT",
    "retrieval_tfidf_train_only": "TF-IDF train-only",
    "retrieval_visual": "Visual",
    "retrieval_multimodal": "Multimodal",
    "vlm_zero_shot": "VLM zero-shot",
    "vlm_zero_shot_by_image": "VLM zero-shot by-image",
    "vlm_zero_shot_rag_e5_small_enriched": "VLM zero-shot + RAG",
    "vlm_zero_shot_by_image_rag_e5_small_longest": "VLM zero-shot + RAG by-image",
    "vlm_lora": "VLM LoRA",
    "vlm_lora_case_avg": "VLM LoRA case-avg",
    "vlm_lora_rag_e5_small_enriched": "VLM LoRA + RAG",
    "vlm_lora_by_image": "VLM LoRA by-image",
    "vlm_lora_by_image_rag_e5_small_longest": "VLM LoRA + RAG by-image",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: White space of Unicode, and the four separators that Python's strip and split take for it too.
BLANK = r"\s\x1c-\x1f"


def strip(c: Column | str) -> Column:
    """Text without white space of any kind at its ends; null stays null."""
    return F.regexp_replace(_col(c), rf"(?U)\A[{BLANK}]+|[{BLANK}]+\z", "")


def is_blank(c: Column | str) -> Column:
    """Whether a text is null, empty or nothing but white space; most texts tell by their first character."""
    t = F.coalesce(_col(c), F.lit(""))
    return F.when(F.ascii(t).between(33, 126), False).otherwise(~t.rlike(rf"(?U)[^{BLANK}]"))


def clean_text(c: Column | str) -> Column:
    """White space of any kind to one space, trimmed; null to empty."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), rf"(?U)[{BLANK}]+", " "))


def normalize(c: Column | str) -> Column:
    return clean_text(F.lower(_col(c)))


def normalize_answer(c: Column | str) -> Column:
    return clean_text(F.lower(_col(c)))


def normalize_text(c: Column | str) -> Column:
    """Lower case without . , ; : and with single spaces."""
    return clean_text(F.regexp_replace(F.lower(_col(c)), "[.,;:]", ""))


def _class(points: list[int]) -> str:
    """Regular expression class of code points, by ranges."""
    out, begin = [], None
    for k, p in enumerate(points):
        begin = p if begin is None else begin
        if k + 1 == len(points) or points[k + 1] != p + 1:
            out.append(f"\\x{{{begin:x}}}" if begin == p else f"\\x{{{begin:x}}}-\\x{{{p:x}}}")
            begin = None
    return f"[{''.join(out)}]"


#: Below it are the letters of ASCII and the Latin blocks that most texts stay in.
LATIN_END = 0x250


@cache
def _decompositions() -> tuple:
    """Compatibility decompositions without combining marks, of the first two planes but for Hangul: letters with one base and those
    bases, the same below LATIN_END, the class of letters of several, these as text, the class of combining marks, and the
    class of what is below LATIN_END and has no several."""
    single, several, marks = {}, {}, []
    for p in range(0x80, 0x20000):
        if 0xAC00 <= p <= 0xD7A3 or 0xD800 <= p < 0xE000:
            continue
        c = chr(p)
        if unicodedata.combining(c):
            marks.append(p)
            continue
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if base != c:
            (single if len(base) == 1 else several)[c] = base
    latin = {a: b for a, b in single.items() if ord(a) < LATIN_END}
    simple = _class([p for p in range(LATIN_END) if chr(p) not in several])
    return ("".join(single), "".join(single.values())), ("".join(latin), "".join(latin.values())), _class(sorted(map(ord, several))), "\x02".join(f"{a}\x01{b}" for a, b in several.items()), _class(marks), simple


def fold(c: Column | str) -> Column:
    """Lower case, compatibility-decomposed, without combining marks. Latin letters of one base go by a small table; only texts with
    anything else take the whole one. Hangul stays composed."""
    every, latin, several, table, marks, simple = _decompositions()
    low = F.lower(F.coalesce(_col(c), F.lit("")))
    whole = F.translate(low, *every)
    found = F.array_distinct(F.regexp_extract_all(whole, F.lit(several), F.lit(0)))
    spelled = F.aggregate(found, whole, lambda t, x: F.replace(t, x, F.element_at(F.str_to_map(F.lit(table), F.lit("\x02"), F.lit("\x01")), x)))
    return F.when(low.rlike(f"\\A{simple}*\\z"), F.translate(low, *latin)).otherwise(F.regexp_replace(spelled, f"{marks}+", ""))


def words(c: Column | str) -> Column:
    """White-space words of cleaned text (empty text: no words)."""
    t = clean_text(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def folded_tokens(c: Column | str, least: int = 1) -> Column:
    """Runs of letters, digits and underscores of folded text."""
    return F.regexp_extract_all(fold(c), F.lit(rf"[\p{{L}}\p{{N}}_]{{{least},}}"), F.lit(0))


def word_count(c: Column | str) -> Column:
    return F.size(words(c)).cast("long")


def question_text(title: Column | str, content: Column | str, separator: str = " ") -> Column:
    """Title and content without blank parts; the space form is cleaned as a whole, the newline form part by part."""
    if separator == " ":
        return clean_text(F.concat_ws(" ", title, content))
    there = lambda c: F.when(~is_blank(c), strip(c))
    return F.concat_ws(separator, there(title), there(content))


def length_bucket(n: Column) -> Column:
    return F.when(n <= 20, "short_0_20").when(n <= 60, "medium_21_60").otherwise("long_61_plus")


def truncate(c: Column | str, limit: int = 280) -> Column:
    t = clean_text(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…")))


def is_generic(c: Column | str, markers: list[str] = GENERIC_MARKERS) -> Column:
    t, out = normalize(c), F.lit(False)
    for m in markers:
        out = out | t.contains(m)
    return out


def quality_flags(c: Column | str) -> dict[str, Column]:
    return {"auto_empty": is_blank(c), "auto_short": word_count(c) < 8, "auto_generic": is_generic(c)}


def safe_number(c: Column | str) -> Column:
    """Finite number of a string, else null."""
    x = F.expr(f"try_cast({c} AS double)") if isinstance(c, str) else c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def three_decimals(c: Column | str) -> Column:
    """Number with three decimals, empty where missing or not finite."""
    x = safe_number(c)
    return F.when(x.isNull(), "").otherwise(F.format_string("%.3f", x))


def relative_path(c: Column | str, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(_col(c).startswith(root), F.substring(_col(c), len(root) + 1, 1 << 30)).otherwise(_col(c))


def mapped(c: Column | str, table: dict[str, str]) -> Column:
    """Value of a small fixed table, itself where the table has none."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[_col(c)], _col(c))


def dataset_variant(value: Column | str, path: Column | str, default: str = "dataset_longest_answer") -> Column:
    v, p = strip(F.coalesce(_col(value), F.lit(""))), F.replace(_col(path), F.lit("\\"), F.lit("/"))
    by_path = F.when(p.contains("dataset_enriched"), "dataset_enriched").when(p.contains("dataset_longest_answer"), "dataset_longest_answer").otherwise(default)
    return F.when(v == "", by_path).otherwise(mapped(v, VARIANT_ALIASES))


def method_label(c: Column | str) -> Column:
    return mapped(c, METHOD_LABELS)


def short_name(c: Column | str) -> Column:
    """Method label for narrow tables: "VLM " left out, white space as in clean_text."""
    return clean_text(F.replace(method_label(c), F.lit("VLM "), F.lit("")))


def split_label(c: Column | str) -> Column:
    return mapped(c, SPLIT_LABELS)


def method_token(c: Column | str) -> Column:
    return F.translate(_col(c), "/-.", "___")


def json_string(c: Column | str) -> Column:
    """A JSON string literal of the text."""
    return F.to_json(F.array(F.coalesce(_col(c), F.lit("")))).substr(F.lit(2), F.length(F.to_json(F.array(F.coalesce(_col(c), F.lit(""))))) - 2)


def source_hash(fields: dict[str, Column | str]) -> Column:
    """sha256 of the JSON object of text fields, keys sorted, with ", " and ": " between."""
    parts = [F.concat(F.lit(f'"{k}": '), json_string(fields[k])) for k in sorted(fields)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256)


def safe_file_name(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"[^A-Za-z0-9_.-]+", "_")


def image_count(c: Column | str) -> Column:
    """Number of images of a list literal or of ;-separated names."""
    t = strip(F.coalesce(_col(c), F.lit("")))
    listed = F.size(F.filter(F.split(F.regexp_replace(t, r"^\[|\]$", ""), ","), lambda x: ~is_blank(x)))
    split = F.size(F.filter(F.split(t, ";"), lambda x: ~is_blank(x)))
    return F.when(t == "", 0).when(t.startswith("["), listed).otherwise(split)


def first_answer(*columns: str) -> Column:
    """First answer that isn't blank, cleaned."""
    clean = [clean_text(c) for c in (columns or ANSWER_COLUMNS)]
    return F.coalesce(*[F.when(c != "", c) for c in clean], F.lit(""))


def round_half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)
