"""Token counts by a public tokenizer, in Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame

DEFAULT = "byte_bpe_multi_50k.tiktoken"


def encoder(path: str | None = None):
    """The tiktoken encoding of a ranks file; without ``path`` the installed multilingual byte-level BPE.

    Kept for the life of the Python worker."""
    import base64

    import public_tokenizers
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_kept_encodings", {})
    if path not in kept:
        with open(path or public_tokenizers.path(DEFAULT), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        kept[path] = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[path]


def token_counts(docs: DataFrame, id_col: str, text_col: str, *carry: str, tokenizer: str | None = None) -> DataFrame:
    """(id, n_tokens BIGINT, *carry) of every row; null text has 0 tokens. Strings of special tokens count as plain text."""
    types = dict(docs.dtypes)
    schema = f"`{id_col}` {types[id_col]}, n_tokens bigint" + "".join(f", `{c}` {types[c]}" for c in carry)
    out = [id_col, "n_tokens", *carry]

    def run(batches):
        import pyarrow as pa

        e = encoder(tokenizer)
        for b in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(b.column(i + 2) for i in range(len(carry)))], names=out)

    return docs.select(id_col, text_col, *carry).mapInArrow(run, schema)
