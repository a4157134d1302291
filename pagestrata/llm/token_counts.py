"""Token counts of a sentencepiece model, from the piece counts of distinct pre-tokens.

No piece of the model holds a space behind another character, and none holds a line break. Merges therefore never
cross a place where a space follows something else, nor a line break, and a text falls into *pre-tokens* there: spaces
with the word behind them, or a line break with the word behind it. A text's count is the sum over its pre-tokens.

The pre-token frequencies of each document meet the piece counts by pre-token: all rows of a pre-token go to one task, which
counts its pieces once and passes on frequency times pieces, summed per document. Pre-tokens that are common in the whole
corpus would make such a task hot, and rows for nothing. The ``COMMON`` commonest ones, counted over all documents
first, are priced once and summed where they are read, from a table of fixed size. Which pre-tokens are in that table
changes no result.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagestrata.llm import base

#: Entries of the table every task holds, and the longest pre-token in it: at most 200,000 x 48 characters.
COMMON, COMMON_CHARS = 200_000, 48
#: Distinct pre-tokens a task holds at a time, and its commonest ones that it puts forward for the table.
HELD, PUT_FORWARD = 250_000, 60_000
BATCH_ROWS = 2048
_PRETOKEN = re.compile(r"\n[^ \n]*| +[^ \n]*")
_SPACE_MARK = "▁"


def pretokens(text: str) -> list[str]:
    """Pre-tokens of a text, each without the one space in front that the model puts there itself."""
    if not text:
        return []
    if _SPACE_MARK in text:
        text = text.replace(_SPACE_MARK, " ")
    if "  " in text or " \n" in text or text[0] in " \n" or text[-1] == " ":
        return [p[1:] if p[0] == " " else p for p in _PRETOKEN.findall(" " + text)]
    return text.replace("\n", " \n").split(" ")


def load_model(path: str):
    """The model; refuses one whose pieces could cross a pre-token's border."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)):
            piece = model.id_to_piece(i)
            if _SPACE_MARK in piece.lstrip(_SPACE_MARK) or "\n" in piece:
                raise ValueError(f"piece {piece!r} crosses pre-tokens")
    return model


def count_pieces(model, words: list[str]) -> list[int]:
    """Pieces of each pre-token, as inside a text."""
    # behind a line break the model's own space stands alone and is no part of the text; a lone space encodes as nothing
    return [
        len(ids) - 1 if word[:1] == "\n" else len(ids) or 1
        for word, ids in zip(words, model.encode(words, num_threads=1))
    ]


def common_pieces(docs: DataFrame, model_path: str) -> dict[str, int]:
    """Piece counts of the commonest pre-tokens of all documents."""
    schema = "word string, n long"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def put_forward(held: Counter):
        top = [(w, n) for w, n in held.most_common(PUT_FORWARD) if len(w) <= COMMON_CHARS and n > 1]
        return pa.RecordBatch.from_pydict({"word": [w for w, _ in top], "n": [n for _, n in top]}, schema=arrow)

    def counted(batches):
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(pretokens(text))
            if len(held) > HELD:
                yield put_forward(held)
                held.clear()
        yield put_forward(held)

    words = docs.select("text").mapInArrow(counted, schema).groupBy("word").agg(F.sum("n").alias("n"))
    words = words.orderBy(F.desc("n"), "word").limit(COMMON).select("word").toPandas()["word"].tolist()
    return dict(zip(words, count_pieces(load_model(model_path), words)))


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """Tokens of every whole text: (doc_id, n_bytes, n_tokens, over_limit), one row per row of ``docs``.

    A null text counts as empty and has no tokens. Repeated rows and null ids stay as they are. Other columns are not
    looked at. An empty table gives an empty result.
    """
    base.small_batches(docs.sparkSession, BATCH_ROWS)
    known = docs.sparkSession.sparkContext.broadcast(common_pieces(docs, model_path))
    schema = "row_id long, word string, n long, doc_id long, n_bytes long"

    def frequencies(batch, table):
        """A row per rare pre-token, and one of the document itself (it has n_bytes) with the tokens summed so far."""
        rows, words, ns, docs_, sizes = [], [], [], [], []
        for row, doc, text in zip(batch["row_id"], batch["doc_id"], batch["text"]):
            parts = pretokens(text)
            got = list(map(table.get, parts))
            rare = Counter(w for w, n in zip(parts, got) if n is None)
            m = len(rare)
            rows += [row] * (m + 1)
            words += [*rare, f"\n{row}"]
            ns += [*rare.values(), sum(filter(None, got))]
            docs_ += [None] * m + [doc]
            sizes += [None] * m + [len((text or "").encode())]
        return {"row_id": rows, "word": words, "n": ns, "doc_id": docs_, "n_bytes": sizes}

    def priced(batch, state):
        model, held = state
        if len(held) > HELD:
            held.clear()
        new = list({w for w, size in zip(batch["word"], batch["n_bytes"]) if size is None and w not in held})
        held.update(zip(new, count_pieces(model, new)))
        tokens = [n if size is not None else n * held[w] for w, n, size in zip(batch["word"], batch["n"], batch["n_bytes"])]
        return {"row_id": batch["row_id"], "doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "tokens": tokens}

    each = base.map_batches(base.with_row(docs, "doc_id", "text"), frequencies, schema, start=lambda: known.value)
    joined = base.map_batches(
        each.repartition("word"), priced, "row_id long, doc_id long, n_bytes long, tokens long", start=lambda: (load_model(model_path), {})
    )
    total = joined.groupBy("row_id").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("tokens").alias("n_tokens"))
    return total.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
