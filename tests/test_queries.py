"""Every registered query against its SQL in DuckDB, or for those without SQL against plain Python."""

import hashlib
import os
import re

import duckdb
import pytest

from siftfield.plans.registry import FLAGSHIP, ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{small}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(name, spark, small, db, tmp_path):
    QUERIES[name](spark, small).write.parquet(str(tmp_path / "out"))
    db.sql(f"CREATE OR REPLACE TABLE want AS {ORACLE_SQL[name]}")
    db.sql(f"CREATE OR REPLACE TABLE raw AS SELECT * FROM read_parquet('{tmp_path}/out/*.parquet')")
    columns = sorted(r[0] for r in db.sql("DESCRIBE want").fetchall())
    assert columns == sorted(r[0] for r in db.sql("DESCRIBE raw").fetchall())
    listed = ", ".join(f'"{c}"' for c in columns)
    for a, b in (("raw", "want"), ("want", "raw")):
        assert db.sql(f"SELECT {listed} FROM {a} EXCEPT ALL SELECT {listed} FROM {b}").fetchall() == []


def test_flagship_has_rows(spark, small):
    assert FLAGSHIP(spark, small).count() > 0


def plain_windows(text, size, share, tail):
    """Chunks by the rule, word by word: a chunk closes when its words, each with a space, reach the size; the
    last share of its words begins the next one; what is left counts if it's longer than the tail."""
    out, now = [], []
    for word in text.split():
        now.append(word)
        if sum(len(w) + 1 for w in now) >= size:
            out.append(" ".join(now))
            now = now[len(now) - int(len(now) * share) :]
    return out + [" ".join(now)] if now and len(" ".join(now)) > tail else out


def test_word_chunks(spark, small, db):
    got = sorted((r.doc_id, r.chunk_index, r.text) for r in QUERIES["word_chunks"](spark, small).collect())
    docs = db.sql("SELECT doc_id, text FROM documents").fetchall()
    assert got == sorted((i, k, x) for i, t in docs for k, x in enumerate(plain_windows(t, 500, 0.2, 50)))


def test_semantic_chunks(spark, small, db):
    got = sorted((r.doc_id, r.chunk_index, -1 if r.sub_index is None else r.sub_index, r.section_type, r.text, r.chunk_id, round(r.relevance, 9)) for r in QUERIES["semantic_chunks"](spark, small).collect())
    kinds = [("dosage", "dosis|dosificaci[oó]n"), ("application", "aplicaci[oó]n|instrucciones"), ("waiting_period", "carencia"), ("limits", "m[aá]ximo.*aplicaciones"), ("interval", "intervalo"), ("precautions", "precauciones|advertencias"), ("composition", "composici[oó]n")]
    terms = "aplicacion dosis tratamiento cultivo plaga fungicida herbicida insecticida temporada hectarea maximo minimo dias frecuencia carencia intervalo litros gramos".split()
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    want = []
    for i, text in db.sql("SELECT doc_id, text FROM documents").fetchall():
        pieces = re.split(r"(?i)\n\s*(?=(?:the|le|der|la).{0,120}:?)", text)
        rows = []
        if len(pieces) <= 2:
            rows = [(k, -1, "character_split", x) for k, x in enumerate(plain_windows(text, 500, 0.2, 50))]
        else:
            for k, piece in enumerate(p.strip(" \n\t\r") for p in pieces):
                if len(piece) < 50:
                    continue
                kind = next((name for name, p in kinds if re.search(p, piece.lower())), "general")
                cut = plain_windows(piece, 500, 0.2, 0) if len(piece) > 750 else None
                rows += [(k, -1, kind, piece)] if cut is None else [(k, j, kind, x) for j, x in enumerate(cut)]
        for k, j, kind, x in rows:
            name = f"chunk_{md5(f'{i}_{k}_{x[:100]}')[:12]}" if j < 0 else f"chunk_{k}_{j}_{md5(x[:100])[:8]}"
            n = len(x.split())
            want.append((i, k, j, kind, x, name, round(min(1.0, 2.0 * sum(x.lower().count(t) for t in terms) / n), 9) if n else 0.0))
    assert got == sorted(want) and {r[3] for r in got} > {"character_split"}


def test_message_segments(spark, small, db):
    got: dict = {}
    for r in QUERIES["message_segments"](spark, small).collect():
        got.setdefault(r.doc_id, []).append((r.part, r.parts, r.text))
    for i, text in db.sql("SELECT doc_id, text FROM documents").fetchall():
        rest, want = text.strip(), []
        while len(rest) > 1500:  # the last newline, else the last space, at 900 or later, else 1500
            marks = [[k for k in range(900, 1500) if rest[k] == c] for c in "\n "]
            at = (marks[0] or marks[1] or [1500])[-1]
            want += [rest[:at].strip()] if rest[:at].strip() else []
            rest = rest[at:].strip()
        want += [rest] if rest or not want else []
        marked = [f"[{k + 1}/{len(want)}] {x}" if len(want) > 1 else x for k, x in enumerate(want)]
        assert sorted(got[i]) == [(k + 1, len(want), x) for k, x in enumerate(marked)]
