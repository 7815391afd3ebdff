"""Passages against a plain reading that carries strings instead of offsets, on random pages and on all given documents."""

import random
import re
from pathlib import Path

import pytest

from corpusloom.config import CHUNKING, Chunking
from corpusloom.functions import fixed as X
from corpusloom.operators import chunk


def cut(text, most):
    """Sentences packed while they fit, counted with the blank after each; what is longer is cut hard."""
    runs, room = [], -1
    for s in re.split(X.SENTENCE_END, text):
        if s.strip():
            if room - len(s.strip()) - 1 < 0:
                runs.append(s.strip())
                room = most - len(s.strip())
            else:
                runs[-1] += " " + s.strip()
                room -= len(s.strip()) + 1
    return [p.strip() for r in runs for p in (r[i : i + most] for i in range(0, len(r), most)) if p.strip()]


def is_heading(line):
    line = line.strip()
    return bool(line) and len(line) <= 72 and (line[-1] == ":" or (re.match(X.HEADING, line) is not None and len(line.split()) < 10))


def brute(pages, title, limits):
    target, overlap, least = (int(n * limits.chars_per_token) for n in (limits.target_tokens, limits.overlap_tokens, limits.min_tokens))
    most = target - (len(title) + 1 if title else 0)
    lines = []
    for number, page in enumerate(pages, 1):
        blocks = []
        for b in re.split(X.PARAGRAPH_SPLIT, page or ""):
            if b and b.strip():
                head, _, rest = b.strip().partition("\n")
                blocks += [x for x in ([head.strip(), rest.strip()] if rest and is_heading(head) else [b.strip()]) if x.strip()]
        for b in blocks:
            name = None if not is_heading(b) else "" if re.match(X.FIELD_LABEL, b.strip()) else b.strip().rstrip(":")
            lines += [(p, number, name if i == 0 else None) for i, p in enumerate([b] if len(b) <= most else cut(b, most))]
    found, now, page, section = [], None, 1, ""
    for text, number, name in lines:
        if name is not None:
            if now is not None and len(now) >= least:
                found.append((now, page, number, section))
                now = None
            section = name or section
        if now is not None and len(now) + 1 + len(text) > most and len(now) >= least:
            found.append((now, page, number, section))
            now = now[-overlap:].lstrip() or None if 0 < overlap < len(now) else None
            page = number
        page = number if now is None else page
        now = text if now is None else f"{now}\n{text}"
    if now is not None and len(now) >= least:
        found.append((now, page, max(len(pages), 1), section))
    out = []
    for text, first, last, section in found:
        parts, wait = [], []
        for p in [text] if len(text) <= most else cut(text, most):
            wait.append(p)
            if len(text) <= most or len(" ".join(wait)) >= least:
                parts.append(" ".join(wait))
                wait = []
        if wait and parts:
            parts[-1] += " " + " ".join(wait)
        for body in parts:
            above = ([title] if title and title[:40].lower() != body[:120].lower()[: len(title[:40])] else []) + ([section] if section.lower() not in body[:200].lower() else [])
            out.append(("\n".join([*above, body]), first, last))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_random_pages(seed):
    r = random.Random(seed)
    parts = ["Yam grows well.", "HARVEST NOTES:", "Symptoms:", "Pests of maize", "\n\n", "\n", " ", "• item one", "12", "A long run " * 20, "x" * 90, "Is it dry? Yes! ", "Ünder é."]
    for _ in range(150):
        pages = [None if r.random() < 0.1 else "".join(r.choice(parts) + r.choice(["", " ", "\n", "\n\n"]) for _ in range(r.randrange(25))) for _ in range(r.randrange(4))]
        limits = Chunking(r.choice([30, 60, 120]), r.choice([0, 5, 20]), r.choice([0, 5, 15]), 3.5)
        title = r.choice(["", "Yam grows", "Guide"])
        assert chunk.pack(pages, title, limits) == brute(pages, title, limits), (pages, title, limits)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="no test tables here")
def test_all_given_documents(spark):
    from corpusloom.plans import registry

    got: dict = {}
    for x in registry.QUERIES["chunk_documents"](spark, "/root/testdata/sf0.001").orderBy("doc_id", "chunk_index").collect():
        got.setdefault(x["doc_id"], []).append((x["text"], x["page_start"], x["page_end"]))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert got == {str(d["doc_id"]): b for d in docs if (b := brute([d["text"] or ""], d["source"] or "", CHUNKING))}
