"""Subword vocabulary: spec parsing (T8), unigram-LM learning as iterated Spark
jobs (M1, M2), tokenization (T9, T7), id lookups (J5), detokenization (T10),
special-token audit (J6) and vocabulary triage (A18).

Learning: the words of the documents are counted; distinct words are normalized as the library does by
default and pre-split natively into units, and ``unigram_learner`` makes a vocabulary of the units and
their counts.  Where units go across white space, whole documents are normalized and pre-split.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.functions.text import MAX_SENTENCE_BYTES, btrim, has_reserved_mark
from corpusforge.functions.normalizer import normalize_text
from corpusforge.operators.unigram_encoder import Encoder
from corpusforge.operators.unigram_learner import SEED_SIZE, UNK_PENALTY, learn_pieces, repeated_substrings
from corpusforge.operators.vocab_stats import avg_token_len as vocab_avg_token_len
from corpusforge.operators.word_counts import word_counts

# Fixed values from the reference: the vocabulary-name grammar (switches in this
# order), pieces per "K", maximum piece length, the space marker, and the special
# pieces (unknown, begin, end; control <pad>; user-defined <mask>).
SPEC_PATTERN = r"\bcc-html([0-9]+)K(,su=f)?(,sn=f)?(,sw=f)?(,ws=t)?(,wo=t)?(,sd=t)?$"
PIECES_PER_K = 1024
MAX_PIECE_LEN = 64
SPACE = "▁"
SPECIALS = [("<unk>", "UNKNOWN"), ("<s>", "CONTROL"), ("</s>", "CONTROL"), ("<pad>", "CONTROL"), ("<mask>", "USER_DEFINED")]

CHAR_COVERAGE = 0.9995
#: Most pieces of a vocabulary that every worker gets.
MAX_PIECES = 2_000_000
VOCAB_SCHEMA = "id INT, piece STRING, score FLOAT, type STRING"


@dataclass(frozen=True)
class VocabSpec:
    size: int
    split_by_unicode_script: bool = True
    split_by_number: bool = True
    split_by_whitespace: bool = True
    whitespace_as_suffix: bool = False
    whitespace_only_pieces: bool = False
    split_digits: bool = False
    #: Not part of the name: whether runs of white space become one mark, as they do by default.  Without runs there
    #: is nothing for ``whitespace_only_pieces`` to change.
    join_spaces: bool = True

    @staticmethod
    def parse(name: str) -> "VocabSpec":
        m = re.search(SPEC_PATTERN, name)
        if not m:
            raise ValueError(f'"{name}" must match {SPEC_PATTERN}')
        return VocabSpec(
            size=int(m[1]) * PIECES_PER_K,
            split_by_unicode_script=not m[2],
            split_by_number=not m[3],
            split_by_whitespace=not m[4],
            whitespace_as_suffix=bool(m[5]),
            whitespace_only_pieces=bool(m[6]),
            split_digits=bool(m[7]),
        )


# ------------------------------------------------------------------ pre-splitting
_SCRIPTS = [r"\p{IsLatin}", r"\p{IsHan}", r"\p{IsHiragana}\p{IsKatakana}", r"\p{IsCyrillic}", r"\p{IsGreek}",
            r"\p{IsArabic}", r"\p{IsHangul}", r"\p{IsHebrew}", r"\p{IsThai}", r"\p{IsDevanagari}"]


def unit_pattern(spec: VocabSpec, user_symbols: Sequence[str] = ()) -> str:
    """Java regex whose matches are the pre-split units of normalized text.

    ``user_symbols`` (user-defined pieces such as ``<mask>``) become units of their
    own wherever they occur, and a space marker right before one stands alone, as
    the SentencePiece encoder matches them.
    """
    # possessive repeats: the matcher runs over them in a loop, without a stack frame for each character
    num = r"\p{N}" if spec.split_digits else r"\p{N}++"
    named = "".join(_SCRIPTS)
    guard = ""
    if user_symbols:
        alts_u = "|".join(f"\\Q{u}\\E" for u in sorted(user_symbols, key=len, reverse=True))
        guard = f"(?!{alts_u})"
    if spec.split_by_unicode_script:
        letters = [f"[{s}\\p{{M}}]" for s in _SCRIPTS] + [f"[\\p{{L}}&&[^{named}]]"]
        if not spec.split_by_number and not spec.split_digits:
            letters = [c[:-1] + r"\p{N}]" for c in letters]
        classes = [f"(?:{guard}{c})++" for c in letters] + [f"(?:{guard}[^\\p{{L}}\\p{{M}}\\p{{N}}\\s▁])++"]
    else:
        cls = r"[^\p{N}\s▁]" if (spec.split_by_number or spec.split_digits) else r"[^\s▁]"
        classes = [f"(?:{guard}{cls})++"]
    if spec.split_by_number or spec.split_digits or spec.split_by_unicode_script:
        classes.append(num)
    if not spec.split_by_whitespace:
        # units may cross the space marker, but never a class boundary
        alts = [f"{SPACE}?{c}(?:{SPACE}{c})*+{SPACE}?" if spec.whitespace_as_suffix else f"{SPACE}?{c}(?:{SPACE}{c})*+" for c in classes]
    elif spec.whitespace_as_suffix:
        alts = [f"{c}{SPACE}?" for c in classes]
    else:
        alts = [f"{SPACE}?{c}" for c in classes]
    if not spec.join_spaces:
        # marks before (behind) the one of a word: a unit together, or one by one
        run = f"{SPACE}++" if spec.whitespace_only_pieces else SPACE
        if spec.whitespace_as_suffix or not spec.split_by_whitespace:
            alts.append(run)
        elif spec.whitespace_only_pieces:
            alts += [f"{SPACE}+(?={SPACE}[^{SPACE}])", run]
        else:
            alts.append(f"{SPACE}(?=[{SPACE}])")
            alts.append(run)
    if user_symbols:
        alts = [alts_u, f"{SPACE}(?={alts_u})"] + alts
    return "|".join(alts)


def normalize(text: Column, spec: VocabSpec) -> Column:
    """The library's default normalization; white-space runs become one space marker, and one is added before (or after) the text."""
    t = normalize_text(text)
    if spec.join_spaces:
        t = F.regexp_replace(F.regexp_replace(t, r"\A[ \t\n\f\r]++|[ \t\n\f\r]++\z", ""), r"[ \t\n\f\r]++", SPACE)
    else:
        t = F.regexp_replace(t, r"[ \t\n\f\r]", SPACE)
    return F.concat(t, F.lit(SPACE)) if spec.whitespace_as_suffix else F.concat(F.lit(SPACE), t)


def presplit(text: Column, spec: VocabSpec, user_symbols: Sequence[str] = ()) -> Column:
    return F.regexp_extract_all(normalize(text, spec), F.lit(unit_pattern(spec, user_symbols)), 0)


def corpus_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """M1: bound each document to 32 KiB (byte-bounded middle cut), drop those with the reserved mark."""
    t = btrim(F.col(text), MAX_SENTENCE_BYTES)
    return docs.select(t.alias("text")).where(~has_reserved_mark(F.col("text")))


def splits_at_words(spec: VocabSpec, user_symbols: Sequence[str] = ()) -> bool:
    """Whether the units of a text are those of its words.

    No unit has white space inside, and no rule of the normalizer or of the units looks beyond it; but a mark behind
    a word may be a unit because of a user-defined symbol behind it.
    """
    if spec.whitespace_as_suffix and user_symbols:
        return False
    return spec.split_by_whitespace and spec.join_spaces and not any(SPACE in u for u in user_symbols)


def corpus_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n, kept): how often each word occurs in the texts as they are, and in those of ``corpus_text``.

    A text that ``corpus_text`` leaves as it is is read once for both.
    """
    cut = btrim(F.col(text), MAX_SENTENCE_BYTES)
    rows = docs.select(F.col(text).alias("text"), cut.alias("cut"), (~has_reserved_mark(cut)).alias("fit"))
    whole = F.col("fit") & (F.col("text") == F.col("cut"))
    return word_counts(rows.select("text", whole.alias("whole"), F.when(F.col("fit") & ~whole, F.col("cut")).alias("cut")))


def _once(texts: DataFrame, text: str, whole: bool) -> DataFrame:
    """Rows for ``word_counts``: texts that are all kept as they are, or none."""
    return texts.select(F.col(text).alias("text"), F.lit(whole).alias("whole"), F.lit(None).cast("string").alias("cut"))


def unit_counts(docs: DataFrame, spec: VocabSpec, text: str = "text", words: DataFrame | None = None) -> DataFrame:
    """(unit, c): how often each unit occurs; ``words`` are the documents' ``corpus_words``, if they are known."""
    texts = corpus_text(docs.select(text), text)
    if not splits_at_words(spec):
        rows = texts.select(F.col("text").alias("word"), F.lit(1).cast("long").alias("kept"))
    else:
        rows = (word_counts(_once(texts, "text", True)) if words is None else words).where("kept > 0")
    units = rows.select(F.explode(presplit(F.col("word"), spec)).alias("unit"), "kept")
    return units.where(F.length("unit") > 0).groupBy("unit").agg(F.sum("kept").cast("double").alias("c"))


# ------------------------------------------------------------------ seeding
def _chars(counts: DataFrame) -> list[tuple[str, float]]:
    chars = (
        counts.select(F.explode(F.split(F.col("unit"), "(?!^)")).alias("ch"), "c")
        .where(F.length("ch") == 1)
        .groupBy("ch").agg(F.sum("c").alias("f"))
        .orderBy(F.desc("f"), "ch").collect()
    )
    total = sum(r["f"] for r in chars) or 1.0
    kept, acc = [], 0.0
    for r in chars:
        kept.append((r["ch"], r["f"]))
        acc += r["f"]
        if acc / total >= CHAR_COVERAGE:
            break
    return kept


def _largest(found: DataFrame, worth: Column, size: int) -> DataFrame:
    """The ``size`` rows worth most, ties by piece; only rows that are worth as much as the last one are put in order."""
    table = found.groupBy(worth.alias("worth")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    each, n = table.column("worth").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(-each)
    upto = np.cumsum(n[order])
    last = int(np.searchsorted(upto, size))
    least, above = F.lit(float(each[order[last]])), int(upto[last] - n[order[last]])
    return found.where(worth > least).unionByName(found.where(worth == least).orderBy("piece").limit(size - above))


def seed_pieces(counts: DataFrame, spec: VocabSpec, seed_size: int = SEED_SIZE, partitions: int = 8) -> list[tuple[str, float]]:
    """The ``seed_size`` repeated substrings of the units with the largest count x length (ties go to the smaller), in any order."""
    found = repeated_substrings(counts, MAX_PIECE_LEN, partitions).where(F.length("piece") > 1)
    if spec.whitespace_only_pieces:
        # marks together are a piece, or one is part of a word's
        found = found.where(~F.col("piece").rlike(f"{SPACE}{{2}}[^{SPACE}]|[^{SPACE}]{SPACE}{{2}}"))
    found = found.checkpoint(eager=True)
    if found.count() > seed_size:
        found = _largest(found, F.col("f") * F.length("piece"), seed_size)
    top = found.toArrow()
    return list(zip(top.column("piece").to_numpy().tolist(), top.column("f").to_numpy().tolist(), strict=True))


def learn_vocab(docs: DataFrame, spec: str | VocabSpec, text: str = "text", seed_size: int = SEED_SIZE,
                em_iters: int = 2, max_rounds: int = 60, words: DataFrame | None = None) -> DataFrame:
    """Learn a unigram vocabulary of at most ``spec.size`` pieces (specials included).

    Up to ``seed_size`` candidates are considered, whatever the size.  Raises if ``max_rounds`` prunings do not
    reach the target.  ``words`` are the documents' ``corpus_words``, if they are known.
    """
    spec = VocabSpec.parse(spec) if isinstance(spec, str) else spec
    spark = docs.sparkSession
    tasks = spark.sparkContext.defaultParallelism  # units are dealt evenly: one task for each core
    # spread the distinct units over all tasks: every pass is a map over them
    counts = unit_counts(docs, spec, text, words).repartition(tasks).checkpoint(eager=True)
    n_normal = spec.size - len(SPECIALS)
    chars = _chars(counts)
    if len(chars) > n_normal:
        raise ValueError(f"{len(chars)} characters needed for coverage exceed the vocabulary size {spec.size}")
    learned = learn_pieces(counts, seed_pieces(counts, spec, seed_size, tasks), chars, n_normal, em_iters, max_rounds, tasks)
    char_set = {c for c, _ in chars}
    normal = sorted(learned, key=lambda kv: (-kv[1], kv[0]))
    chars_first = [kv for kv in normal if kv[0] in char_set]
    others = [kv for kv in normal if kv[0] not in char_set][: max(0, n_normal - len(chars_first))]
    final = sorted(chars_first + others, key=lambda kv: (-kv[1], kv[0]))
    rows = [(i, p, 0.0, t) for i, (p, t) in enumerate(SPECIALS)]
    rows += [(len(SPECIALS) + i, p, float(s), "NORMAL") for i, (p, s) in enumerate(final)]
    return spark.createDataFrame(rows, VOCAB_SCHEMA)


# ------------------------------------------------------------------ encoding
_ENCODED = T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("ids", T.ArrayType(T.IntegerType()))])


def _vocab_dict(vocab: DataFrame, max_pieces: int) -> dict[str, tuple[int, float]]:
    n = vocab.count()
    if n > max_pieces:
        raise ValueError(f"vocabulary of {n} pieces exceeds the broadcast bound {max_pieces}")
    # control and unknown pieces are never matched from text; user-defined ones are
    usable = vocab.where(~F.col("type").isin("CONTROL", "UNKNOWN"))
    return {r["piece"]: (int(r["id"]), float(r["score"])) for r in usable.collect()}


def _encoder(vocab: DataFrame, max_pieces: int) -> tuple[Broadcast, list[str]]:
    """The vocabulary's encoder for every worker, and its user-defined pieces."""
    pieces = _vocab_dict(vocab, max_pieces)
    user_defined = {r["piece"] for r in vocab.where(F.col("type") == "USER_DEFINED").select("piece").collect()}
    return vocab.sparkSession.sparkContext.broadcast(Encoder(pieces, MAX_PIECE_LEN)), [p for p in pieces if p in user_defined]


def tokenize(docs: DataFrame, vocab: DataFrame, spec: str | VocabSpec, text: str = "text",
             max_length: int | None = None, avg_token_len: float | None = None,
             max_pieces: int = MAX_PIECES) -> DataFrame:
    """Add tokens, input_ids, attention_mask: best unigram segmentation, no bos/eos.

    Normalization and pre-splitting are native; only the unit arrays cross to
    Python, where the distinct units of an Arrow batch are segmented together
    and nothing is kept but the vocabulary.  With ``max_length`` the text is first cut to the length hint (T7)
    and the ids to ``max_length``.
    """
    spec = VocabSpec.parse(spec) if isinstance(spec, str) else spec
    bc, user = _encoder(vocab, max_pieces)
    t = F.col(text)
    if max_length is not None:
        hint = avg_token_len if avg_token_len is not None else vocab_avg_token_len(vocab)
        t = t.substr(F.lit(1), F.ceil(F.lit(float(max_length) * hint)).cast("int"))

    @F.arrow_udf(_ENCODED)
    def encode(units: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return bc.value.encoded(units)

    enc = encode(presplit(t, spec, user))
    out = docs.withColumn("_enc", enc)
    ids = F.col("_enc.ids") if max_length is None else F.slice("_enc.ids", 1, max_length)
    toks = F.col("_enc.tokens") if max_length is None else F.slice("_enc.tokens", 1, max_length)
    return (
        out.withColumn("tokens", toks)
        .withColumn("input_ids", ids)
        .withColumn("attention_mask", F.transform(F.col("input_ids"), lambda _x: F.lit(1).cast("tinyint")))
        .drop("_enc")
    )


#: Rows whose lookups are answered together.
LOOKUP_ROWS = 4096


def _looked_up(df: DataFrame, table: DataFrame, key: str, column: str, out: str, kind: str, missing) -> DataFrame:
    """(key, out): each array's elements looked up in ``table`` (k, v) in their place, whatever its size.

    Rows are dealt into blocks.  The distinct elements of a block meet the table in a shuffled join, and
    the block's rows get the answers back, so a task holds one block and its own part of the table.
    """
    blocks = max(1, -(-df.count() // LOOKUP_ROWS))
    rows = df.select(F.col(key).alias("key"), F.col(column).alias("given"), F.pmod(F.xxhash64(F.col(key), F.col(column)), F.lit(blocks)).alias("block"))
    wanted = rows.select("block", F.explode("given").alias("k")).where("k is not null").distinct()
    answers = wanted.join(table, "k").select(F.col("block").alias("own"), "k", "v")
    arrow = pa.int32() if kind == "int" else pa.string()

    def answer(own: pa.Table, found: pa.Table) -> pa.Table:
        # a block's elements stay in their columns: as Python objects they would take many times their bytes
        given = own.column("given").combine_chunks()
        values = found.column("v").combine_chunks().cast(arrow).take(pc.index_in(given.flatten(), value_set=found.column("k").combine_chunks()))
        if missing is not None:
            values = values.fill_null(missing)
        offsets = np.concatenate([[0], np.cumsum(np.asarray(given.value_lengths().fill_null(0)), dtype=np.int64)])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=given.is_null())
        return pa.table([own.column("key"), lists], names=[key, out])

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, `{out}` array<{kind}>"
    return rows.groupBy("block").cogroup(answers.groupBy("own")).applyInArrow(answer, schema)


def pieces_to_ids(df: DataFrame, vocab: DataFrame, key: str, tokens: str = "tokens", unk_id: int = 0) -> DataFrame:
    """(key, ids): id of each piece in order, unknown pieces map to ``unk_id`` (J5); empty stays empty, null stays null."""
    return _looked_up(df, vocab.select(F.col("piece").alias("k"), F.col("id").alias("v")), key, tokens, "ids", "int", unk_id)


def ids_to_pieces(df: DataFrame, vocab: DataFrame, key: str, ids: str = "input_ids") -> DataFrame:
    """(key, pieces): id outside the vocabulary gives a null piece (J5); empty stays empty, null stays null."""
    return _looked_up(df, vocab.select(F.col("id").alias("k"), F.col("piece").alias("v")), key, ids, "pieces", "string", None)


def detokenize(pieces: Column, whitespace_as_suffix: bool = False) -> Column:
    """Concatenate, turn space markers into spaces, drop the one space that normalization added in front (or behind)."""
    text = F.replace(F.array_join(pieces, ""), F.lit(SPACE), F.lit(" "))
    return F.regexp_replace(text, r" \z" if whitespace_as_suffix else r"\A ", "")


# ------------------------------------------------------------------ specials
def audit_specials(vocab: DataFrame, expected: Sequence[tuple[str | None, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(status table, vocabulary with appended user-defined specials).

    Missing USER_DEFINED pieces are appended with score 0; another missing piece
    or a type mismatch is an error, except an expected USER_DEFINED found as CONTROL.
    """
    spark = vocab.sparkSession
    expected = list(expected) if expected is not None else [(p, t) for p, t in SPECIALS]
    exp = spark.createDataFrame(
        [(i, p, t) for i, (p, t) in enumerate(expected) if p is not None], "ord INT, piece STRING, want STRING"
    )
    j = exp.join(vocab.select("piece", F.col("type").alias("found"), "id"), "piece", "left")
    status = (
        F.when(F.col("found").isNull() & (F.col("want") == "USER_DEFINED"), "appended")
        .when(F.col("found").isNull(), "error: not found")
        .when(F.col("found") == F.col("want"), "ok")
        .when((F.col("want") == "USER_DEFINED") & (F.col("found") == "CONTROL"), "ok")
        .otherwise("error: type mismatch")
    )
    report = j.select("ord", "piece", "want", "found", status.alias("status"))
    rows = report.orderBy("ord").collect()
    bad = [r for r in rows if r["status"].startswith("error")]
    if bad:
        raise ValueError("special tokens not compatible with the vocabulary: " + ", ".join(f"{r['piece']} ({r['status']})" for r in bad))
    nxt = vocab.agg(F.max("id")).collect()[0][0]
    nxt = -1 if nxt is None else nxt
    add = [(nxt + 1 + i, r["piece"], 0.0, "USER_DEFINED") for i, r in enumerate(x for x in rows if x["status"] == "appended")]
    out = vocab.unionByName(spark.createDataFrame(add, VOCAB_SCHEMA)) if add else vocab
    return report, out


# ------------------------------------------------------------------ triage
def _tallied(encoder: Broadcast):
    return lambda batches: encoder.value.tallied(batches)


def vocab_triage(docs: DataFrame, vocabs: dict[str, DataFrame], text: str = "text", words: DataFrame | None = None) -> DataFrame:
    """Bits per character and tokens per character of each vocabulary on ``docs``.

    A token costs its piece's score; an unknown character costs what the encoder charged for it,
    ``UNK_PENALTY`` below the least likely piece, so a vocabulary gains nothing by not knowing a text.
    Whole documents are encoded as ``tokenize`` does: by their distinct words, where no unit and no run of
    unknown characters goes beyond a word.  A task sums up its tokens by id.  ``words`` are the documents'
    ``corpus_words``, if they are known.
    """
    out = None
    chars = F.lit(float(docs.agg(F.sum(F.length(text))).first()[0] or 1))
    for name, voc in vocabs.items():
        spec = VocabSpec.parse(name)
        bc, user = _encoder(voc, MAX_PIECES)
        if splits_at_words(spec, user) and bc.value.parts_at(SPACE):
            if words is None:
                words = word_counts(_once(docs, text, False)).checkpoint(eager=True)
            rows = words.where("n > 0").select(F.col("word").alias("text"), "n")
        else:
            rows = docs.select(F.col(text).alias("text"), F.lit(1).cast("long").alias("n"))
        units = rows.select(presplit(F.col("text"), spec, user).alias("units"), "n")
        usable = ~F.col("type").isin("CONTROL", "UNKNOWN")
        unk = F.broadcast(voc.where(usable).agg((F.coalesce(F.min(F.col("score").cast("double")), F.lit(0.0)) - UNK_PENALTY).alias("unk")))
        scores = voc.where(usable).select("id", F.col("score").cast("double").alias("score"))
        tallies = units.mapInArrow(_tallied(bc), "id int, n long, length long")
        sums = tallies.groupBy("id").agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
        scored = sums.join(scores, "id", "left").crossJoin(unk)  # one row
        cost = F.when(F.col("score").isNull(), -F.col("unk") * F.col("length")).otherwise(-F.col("score") * F.col("n"))
        r = scored.agg(
            (F.sum(cost) / F.lit(math.log(2.0)) / chars).alias("bits_per_char"),
            (F.sum("n") / chars).alias("tokens_per_char"),
        ).select(F.lit(name).alias("vocab"), "*")
        out = r if out is None else out.unionByName(r)
    return out
