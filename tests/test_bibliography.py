"""The splittable bibliography source: any cut of the file gives the same rows."""

from __future__ import annotations

import io

import pytest

from weftline.sources import bibliography, readers

RECORDS = "".join(
    f'<article mdate="2020-01-01" key="j/{k}"><author>J&uuml;rgen {k}</author>\n<author>Bob &amp; Ray</author><title>On <i>x<sub>{k}</sub></i> café.</title>'
    f'<year>{2000 + k % 20}</year><journal>J{k}</journal><booktitle/><ee>https://doi.org/10.1000/{k}</ee></article>\n'
    f'<www key="homepages/1/{k}"><author>J&uuml;rgen {k}</author><author>J. {k}</author><note type="affiliation">U &Eacute;</note><note>no</note></www>\n<book key="b/{k}"/>\n'
    for k in range(40)
)
DUMP = f'<?xml version="1.0" encoding="ISO-8859-1"?>\n<!DOCTYPE dblp SYSTEM "dblp.dtd">\n<dblp>\n{RECORDS}</dblp>\n'.encode("iso-8859-1")


def cuts(size: int, block: int) -> list:
    out = []
    for start in range(0, len(DUMP), size):
        stream = io.BytesIO(DUMP)
        stream.seek(start)
        out += list(bibliography.cut(stream.read, start, min(start + size, len(DUMP)), bibliography.KINDS, block))
    return out


def test_cuts_of_any_size_and_block():
    whole = cuts(len(DUMP), 1 << 20)
    assert len(whole) == 120 and all(DUMP[at : at + len(r)] == r for at, r in whole)
    for size in (1, 7, 100, 333, 5_000):
        for block in (1, 13, 4_096):
            if size * block > 6:
                assert cuts(size, block) == whole


def test_broken_records_raise():
    with pytest.raises(ValueError, match="does not end"):
        list(bibliography.cut(io.BytesIO(b"<dblp><article key='a'><title>").read, 0, 99, bibliography.KINDS))
    with pytest.raises(ValueError, match="unknown entity"):
        bibliography.parsed(b"<book>&nonsense;</book>", "utf-8")
    with pytest.raises(ValueError, match="utf-16"):
        bibliography.declared_encoding(b'<?xml version="1.0" encoding="UTF-16"?>')


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    path = tmp_path_factory.mktemp("dump") / "bib.xml"
    path.write_bytes(DUMP)
    return str(path)


def test_one_range_and_sixteen(spark, dump):
    one = readers.bibliography(spark, dump)
    many = readers.bibliography(spark, dump, range=str(len(DUMP) // 16 + 1))
    assert one.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() == 16
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect())) and one.count() == 120
    assert readers.bibliography(spark, dump, ("book",)).where("key is not null").count() == 40


def test_people_and_works(spark, dump):
    people = readers.bibliography_people(spark, dump, range="999")
    row = people.where("pid = '1/3'").first()
    assert (row.spellings, row.notes) == (["Jürgen 3", "J. 3"], ["U É"])
    works, together = readers.bibliography_works(spark, dump, people, since=2010, range="500")
    assert works.count() == 40 and together.count() == 20
    assert tuple(works.where("pid = '1/3'").first()) == ("1/3", "On x3 café.", 2003, "J3", "article", "10.1000/3")
    assert {r.name for r in together.collect()} == {"Bob & Ray"}


def test_empty_and_packed_dumps(spark, tmp_path):
    import gzip

    (tmp_path / "none").mkdir()
    assert readers.bibliography(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "bib.xml.gz").write_bytes(gzip.compress(DUMP))
    assert readers.bibliography(spark, str(tmp_path / "bib.xml.gz"), range="100").count() == 120


def test_assignments_are_read_by_many_tasks(spark, tmp_path):
    from weftline.sources.readers import assignments

    path = tmp_path / "pairs.csv"
    path.write_text("pid,email,phase,rank_score,affinity\n" + "".join(f'{k},"R, {k}@x.org",fill,0.5,\n' for k in range(5_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = assignments(spark, str(path))
        assert rows.rdd.getNumPartitions() > 3 and rows.distinct().count() == 5_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
