"""Leaves of the line tree against a plain loop."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest

from tallyhouse.llm import arrays, line_templates


@pytest.mark.parametrize("window", [9, 1 << 21])
def test_leaves_tell_lines_apart_like_a_plain_loop(monkeypatch, window):
    monkeypatch.setattr(arrays, "WINDOW_BYTES", window)
    rng = random.Random(window)
    texts = [None, "", "\n", "a", "a\n", "\na1 b", " 7 8\t9 x\n7 8 9 y", "é 1é é"]
    texts += ["\n".join(" ".join(rng.choices(["a", "b", "c3", "12", "Ü9", "Ü", ""], k=rng.randint(0, 6))) for _ in range(rng.randint(0, 9))) for _ in range(200)]
    data, offsets = arrays.text_bytes(pa.array(texts, pa.string()))
    owner, number, leaf, start, past = line_templates.line_leaves(data, offsets)
    want, lines = [], []
    for k, text in enumerate(texts):
        for place, line in enumerate((text or "").split("\n")):
            words = [w for w in re.split("[\x20\x09-\x0d]+", line) if w]
            if words:
                shape = (len(words), *["<*>" if re.search("[0-9]", w) else w for w in words[: line_templates.LEAD]])
                want.append((k, place, shape))
                lines.append(line)
    assert list(zip(owner.tolist(), number.tolist(), strict=True)) == [w[:2] for w in want]
    assert [data[a:b].tobytes().decode() for a, b in zip(start, past, strict=True)] == lines
    shapes = [w[2] for w in want]
    assert len(set(zip(leaf.tolist(), shapes, strict=True))) == len(set(leaf.tolist())) == len(set(shapes))
