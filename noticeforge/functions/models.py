"""Places where a model plugs in: embedders, extractors and generators as Arrow functions, with offline stand-ins."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

Embed = Callable[[Sequence[str]], np.ndarray]


def hash_embedder(size: int = 64) -> Embed:
    """Unit vectors from hashed words: no model, the same everywhere. A text without words is the zero vector."""

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for i, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[i, h % size] += 1 if h >> 40 & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    return embed


def embedder(load: Callable[[], Embed] = hash_embedder, size: int = 64):  # noqa: ANN201
    """An Arrow function text -> array<float>; `load` runs once per task, and a vector of another size is an error."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embed = load()
        for texts in batches:
            known = [t for t in texts.to_pylist() if t is not None]
            vectors = embed(known) if known else np.zeros((0, size), np.float32)
            if vectors.shape[1] != size:
                raise ValueError(f"the model gives {vectors.shape[1]} numbers, not {size}")
            rows = iter(vectors.tolist())
            yield pa.array([None if t is None else next(rows) for t in texts.to_pylist()], pa.list_(pa.float32()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, T.ArrayType(T.FloatType()))


Extract = Callable[[str], dict]


def pattern_rules(patterns: dict[str, str], relation: str = "관련") -> Extract:
    """An extractor without a model: the first group of each type's pattern, each once, and relations from the first entity to the others."""
    compiled = [(kind, re.compile(p)) for kind, p in patterns.items()]

    def extract(text: str) -> dict:
        found = [*dict.fromkeys((kind, m[1]) for kind, p in compiled for m in p.finditer(text))]
        links = [*dict.fromkeys((found[0][1], relation, n) for _, n in found[1:] if n != found[0][1])] if found else []
        return {"entities": [{"type": k, "name": n, "attributes": {}} for k, n in found], "relations": [{"source": s, "relation": r, "target": t} for s, r, t in links]}

    return extract


_ENTITY = pa.struct([("type", pa.string()), ("name", pa.string()), ("attributes", pa.map_(pa.string(), pa.string()))])
_RELATION = pa.struct([("source", pa.string()), ("relation", pa.string()), ("target", pa.string())])
_EXTRACTION = T.StructType([
    T.StructField("entities", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("name", T.StringType()), T.StructField("attributes", T.MapType(T.StringType(), T.StringType()))]))),
    T.StructField("relations", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("source", "relation", "target")]))),
    T.StructField("error_code", T.StringType()), T.StructField("retryable", T.BooleanType()), T.StructField("detail", T.StringType()),
])


def _checked(answer: object) -> dict:
    """An extraction in its schema; anything else is a ValueError, which no further try would mend."""
    told = json.loads(answer) if isinstance(answer, str) else answer
    if not isinstance(told, dict) or not all(isinstance(told.get(k, []), list) for k in ("entities", "relations")):
        raise ValueError("no extraction")
    try:
        entities = [{"type": str(e["type"]), "name": str(e["name"]), "attributes": [(str(k), v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in (e.get("attributes") or {}).items()]} for e in told.get("entities", [])]
        relations = [{k: str(r[k]) for k in ("source", "relation", "target")} for r in told.get("relations", [])]
    except (KeyError, TypeError, AttributeError) as error:
        raise ValueError("no extraction") from error
    return {"entities": entities, "relations": relations, "error_code": None, "retryable": False, "detail": None}


def extract_with_retry(extract: Callable[[str], object], text: str, retries: int = 2, sleep: Callable[[float], None] = time.sleep) -> dict:
    """An extraction, or its failure: an answer out of its schema at once (LLM_INVALID_RESPONSE), others after retries (LLM_CALL_FAILED)."""
    last: Exception | None = None
    for attempt in range(retries + 1):
        try:
            answer = extract(text)
        except Exception as error:  # whatever a provider raises
            last = error
            if attempt < retries:
                sleep(attempt + 1.0)
            continue
        try:
            return _checked(answer)
        except ValueError:
            return {"entities": None, "relations": None, "error_code": "LLM_INVALID_RESPONSE", "retryable": False, "detail": None}
    line = " ".join(str(last).splitlines()).strip()
    detail = f"{type(last).__name__}: {line[:300]}" if line else type(last).__name__
    return {"entities": None, "relations": None, "error_code": "LLM_CALL_FAILED", "retryable": True, "detail": detail}


def extractor(load: Callable[[], Callable[[str], object]], retries: int = 2, sleep: Callable[[float], None] = time.sleep):  # noqa: ANN201
    """An Arrow function text -> struct(entities, relations, error_code, retryable, detail); `load` runs once per task, a null text is null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        extract = load()
        for texts in batches:
            rows = [None if t is None else extract_with_retry(extract, t, retries, sleep) for t in texts.to_pylist()]
            yield pa.array(rows, pa.struct([("entities", pa.list_(_ENTITY)), ("relations", pa.list_(_RELATION)), ("error_code", pa.string()), ("retryable", pa.bool_()), ("detail", pa.string())]))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, _EXTRACTION)


def first_sentence(question: str, context: str) -> str:
    """A generator without a model: the context's first line of text as the answer, the context as its detail."""
    lines = [x for x in context.splitlines() if x.strip() and not x.startswith("[")]
    return f"[핵심 답변]\n{lines[0] if lines else ''}\n\n[상세 답변]\n{context}"


def generator(load: Callable[[], Callable[[str, str], str]]):  # noqa: ANN201
    """An Arrow function (question, context) -> answer; `load` runs once per task."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        generate = load()
        for questions, contexts in batches:
            yield pa.array([None if q is None or c is None else generate(q, c) for q, c in zip(questions.to_pylist(), contexts.to_pylist(), strict=True)], pa.string())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return arrow_udf(run, T.StringType())


#: Providers by name: what each gives for embed, extract, generate and draft (of a specification). Others are registered here.
PROVIDERS: dict[str, dict[str, Callable]] = {"offline": {"embed": hash_embedder, "extract": lambda: pattern_rules({}), "generate": lambda: first_sentence, "draft": lambda: lambda prompt: "{}"}}


def provider(kind: str, name: str | None = None) -> Callable:
    """The loader of a provider's part; the name comes from MODEL_PROVIDER where none is given, else it is the offline one."""
    chosen = (name or os.environ.get("MODEL_PROVIDER") or "offline").lower()
    if chosen not in PROVIDERS or kind not in PROVIDERS[chosen]:
        raise ValueError(f"no provider {chosen} for {kind}")
    return PROVIDERS[chosen][kind]
