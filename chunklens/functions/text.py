"""Text columns: splitting, markers, token windows, answers, names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import slices

#: Word limits of one sentence: beyond the first of a pair it is cut to the second.
TRUNCATE = ((1024, 256), (512, 512))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once for each row, however often f uses it, also inside lambdas."""
    return F.transform(F.array(value), f)[0]


def words(text: Column) -> Column:
    """Non-blank runs of a text; none for null or blank text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Sentences with their closing marks; blank ones are dropped."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^.?!]+[.?!]*"), F.lit(0)), strip)
    return F.filter(found, lambda s: s != "")


def sentences_after_blank(text: Column) -> Column:
    """Split at white space after a closing mark."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.?!])\s+"), lambda s: s != "")


def sentences_cjk(text: Column) -> Column:
    """Split after full-width closing marks, which stay."""
    return F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[^。！？；]*[。！？；]|[^。！？；]+$"), F.lit(0)), lambda s: s != "")


def shorten(sentence: Column) -> Column:
    """Cut an over-long sentence to its first words and an ellipsis."""
    w = words(sentence)
    out = sentence
    for limit, keep in reversed(TRUNCATE):
        out = F.when(F.size(w) > limit, F.concat(F.array_join(F.slice(w, 1, keep), " "), F.lit("..."))).otherwise(out)
    return out


def joined_at(parts: Column, ends: Column, joint: str = "") -> Column:
    """Parts joined into texts, of which one ends with each part whose number (from 0, sorted) is given, and the last with the parts."""

    def texts(v: Column) -> Column:
        last = F.size(v["p"]) - 1
        edges = F.concat(F.array(F.lit(-1)), F.filter(v["e"], lambda e: e < last), F.array(last))
        return let(edges, lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda i: F.array_join(F.slice(v["p"], e[i] + 2, e[i + 1] - e[i]), joint)))

    return let(F.struct(parts.alias("p"), ends.alias("e")), texts)


def positions(text: Column, parts: Column) -> Column:
    """Half-open character offsets of each part, searched from the end of the one before; a miss is put where the last one ended.

    One pass over a text in a batch function: in the JVM, a search from a place would count characters from the start each time.
    """

    @F.arrow_udf("array<struct<sentence:string,start:int,end:int>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for whole, lists in batches:
            for i, n in slices(lists):
                yield placed(whole.slice(i, n), lists.slice(i, n))

    def placed(texts: pa.Array, parts: pa.Array) -> pa.Array:
        starts, ends, edges = [], [], [0]
        for text, own in zip(texts, parts, strict=True):
            text, at = text.as_py() or "", 0
            for s in own.as_py() or []:
                found = text.find(s, at)
                starts.append(found if found >= 0 else at)
                at = starts[-1] + len(s)
                ends.append(at)
            edges.append(len(ends))
        rows = pa.StructArray.from_arrays([parts.flatten(), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["sentence", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), rows)

    return run(text, parts)


def token_windows(tokens: Column, size: int, overlap: int = 0) -> Column:
    """Texts of windows of ``size`` tokens that start every ``size - overlap`` (at least 1) tokens; the last may be short."""
    step = max(1, size - overlap)

    def texts(t: Column) -> Column:
        starts = F.when(F.size(t) > 0, F.sequence(F.lit(0), F.greatest(F.size(t) - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.array_join(F.slice(t, s + 1, size), " "))

    return let(tokens, texts)


def truncate_tokens(text: Column, budget: Column) -> Column:
    """The text if it fits a token budget, else its first tokens."""

    def fitted(v: Column) -> Column:
        cut = lambda t: F.when(F.size(t) <= v["n"], v["text"]).otherwise(F.array_join(F.slice(t, F.lit(1), F.greatest(v["n"], F.lit(0))), " "))
        return let(words(v["text"]), cut)

    return let(F.struct(text.alias("text"), budget.alias("n")), fitted)


def mark(index: Column, sentence: Column) -> Column:
    """A sentence between numbered markers."""
    return F.concat(F.lit("【Begin-"), index.cast("string"), F.lit("】"), sentence, F.lit("【End-"), index.cast("string"), F.lit("】"))


_MARKED = r"(?s)【Begin-(\d+)】(.*?)【End-\1】"


def marked_ids(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_MARKED), F.lit(1)), lambda x: x.cast("int"))


def marked_texts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_MARKED), F.lit(2))


def unmark(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"【Begin-\d+】|【End-\d+】", ""))


def number_lines(parts: Column) -> Column:
    """``ID n: text`` for each part, from 0."""
    return F.transform(parts, lambda s, i: F.concat(F.lit("ID "), i.cast("string"), F.lit(": "), s))


def strip_number(text: Column) -> Column:
    return F.regexp_replace(text, r"^ID \d+:\s*", "")


def answer_number(reply: Column) -> Column:
    """The number in ``Answer: ID n``; null without one."""
    found = F.regexp_extract(F.regexp_extract(reply, r"Answer: ID \w+", 0), r"\d+", 0)
    return F.when(found != "", found.cast("int"))


def parse_answer(reply: Column, key: str = "answer") -> Column:
    """The value of a key in the widest braces of a reply; the whole reply is tried without braces; UNKNOWN if there is none.

    What isn't strict JSON is read again with single quotes, bare names, escapes of any character, comments and last commas admitted.
    """
    inner = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    source = F.when(inner != "", inner).otherwise(reply)
    loose = {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true", "allowBackslashEscapingAnyCharacter": "true", "allowComments": "true"}
    repaired = F.from_json(F.regexp_replace(source, r",\s*([}\]])", "$1"), "map<string,string>", loose)
    return F.coalesce(F.get_json_object(source, f"$.{key}"), repaired[key], F.lit("UNKNOWN"))


_FILE = r"^raw_(.+?)_shard(\d+)_rep(\d+)_(\d{8}_\d{6})\.jsonl$"
_SIZED = r"^(traditional)_(\d+)$"


def file_facts(name: Column) -> Column:
    """Method, size, shard, repeat and time from the name of a result file; null where it has another form.

    A method may have any name; only that of fixed token windows carries its size.
    """
    g = [F.regexp_extract(name, _FILE, k) for k in range(1, 5)]
    sized = g[0].rlike(_SIZED)
    facts = F.struct(
        F.when(sized, F.regexp_extract(g[0], _SIZED, 1)).otherwise(g[0]).alias("method"), F.when(sized, F.regexp_extract(g[0], _SIZED, 2).cast("int")).alias("size"),
        F.when(g[1] != "", g[1]).cast("int").alias("shard"), F.when(g[2] != "", g[2]).cast("int").alias("rep"), F.try_to_timestamp(g[3], F.lit("yyyyMMdd_HHmmss")).alias("at"),
    )
    return F.when(name.rlike(_FILE), facts)


def assignment(spec: Column) -> Column:
    """``2=code;3=a,b`` as a map from worker to its list."""
    return F.transform_values(F.str_to_map(spec, F.lit(";"), F.lit("=")), lambda _, v: F.split(v, ","))


def prompt(context: Column, question: Column, choices: Column) -> Column:
    """Context, question and lettered choices as one text."""
    lines = F.transform(F.map_entries(choices), lambda e: F.concat(e["key"], F.lit(") "), e["value"]))
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\n"), F.array_join(lines, "\n"), F.lit('\nReply with {"answer": letter}.'))


def bucket(token: Column, buckets: int) -> Column:
    """Bucket of a token for hashed bag-of-words vectors; the same in any engine with md5."""
    return (F.conv(F.substring(F.md5(F.lower(token)), 1, 4), 16, 10).cast("int") % buckets).cast("int")
