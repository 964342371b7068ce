"""Public tokenizer files. Their folder is a parameter; by default the installed ``public_tokenizers`` names it."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Callable
from functools import lru_cache

TIKTOKEN_KINDS = ("byte_bpe_50k", "byte_bpe_multi_50k")
PIECE_KINDS = ("piece_bpe_32k",)


def vocab_path(file: str, folder: str | None = None) -> str:
    if folder:
        return os.path.join(folder, file)
    import public_tokenizers

    return str(public_tokenizers.path(file))


def split_pattern() -> str:
    """The published pre-tokenization pattern of the byte-level vocabularies."""
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def byte_ranks(name: str, folder: str | None = None) -> dict[bytes, int]:
    with open(vocab_path(f"{name}.tiktoken", folder), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _file_of(name: str) -> str:
    if name in TIKTOKEN_KINDS:
        return f"{name}.tiktoken"
    if name in PIECE_KINDS:
        return f"{name}.model"
    return f"{name}.json"


@lru_cache(maxsize=8)
def tokenizer_hash(name: str, folder: str | None = None) -> str:
    """Identifies the tokenizer by its content, so that another vocabulary under the same name counts as new."""
    with open(vocab_path(_file_of(name), folder), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:20]


@lru_cache(maxsize=4)
def batch_encoder(name: str, folder: str | None = None) -> Callable[[list[str]], list[list[int]]]:
    """A function from texts to ids, without special tokens; one per worker process."""
    if name in TIKTOKEN_KINDS:
        import tiktoken

        encoding = tiktoken.Encoding(
            name, pat_str=split_pattern(), mergeable_ranks=byte_ranks(name, folder), special_tokens={}
        )
        return lambda texts: [encoding.encode_ordinary(t) for t in texts]
    if name in PIECE_KINDS:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocab_path(_file_of(name), folder))
        return lambda texts: model.encode(texts, num_threads=1) if texts else []
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    loaded = Tokenizer.from_file(vocab_path(_file_of(name), folder))
    loaded.encode_special_tokens = True
    return lambda texts: [e.ids for e in loaded.encode_batch(texts, add_special_tokens=False)]
