"""Rows of every awkward kind."""

#: Names that operators' own columns have; inputs may hold them too.
CLASHING = ("n_bytes", "n_tokens", "keep_id", "kept", "score", "predicted", "lines_before", "lines_dropped", "spans", "base_spans", "set", "block", "p", "x", "host", "component_id", "__key", "norm")
ROWS = [
    (0, "The quick brown fox jumps over the lazy dog. " * 4),
    (1, "The quick brown fox jumps over the lazy dog. " * 4),
    (2, "  the QUICK brown fox\tjumps over the lazy dog.\n" * 4),
    (2, "  the QUICK brown fox\tjumps over the lazy dog.\n" * 4),
    (3, None),
    (4, ""),
    (5, " \t\r\n\x0b\x0c "),
    (None, "no id at all, mail me: a.b@c.org, or +1 (555) 010-0200"),
    (None, None),
    (6, "é你好 😀 ▁ <|endoftext|> <|startoftext|> \x00   don't WE'LL 12½² 1.2.3.4 4111 1111 1111 1111"),
    (7, "x" * 60_000),
    (8, "long text with many words " * 8_000 + "end."),
    (9, "a"),
    (10, "\n".join(["same line"] * 30 + ["other"])),
    (11, "".join(chr(c) for c in range(1, 0x250))),
]


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
