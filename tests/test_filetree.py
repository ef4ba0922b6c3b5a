"""A small tree of files, and what of it is listed."""

from docloom.operators import files
from docloom.sources import filetree


def test_scan(spark, tmp_path):
    tree = {
        "1/DG12/2024_1_a.jpg": b"x", "1/DG12/2024_1_b.JPG": b"x", "1/DG12/deep/c.jpg": b"y", "1/DG13/2024_1_d.png": b"z", "1/DG99/e.jpg": b"z", "1/DG14/notes.txt": b"z",
        "1/DG14/f.page-1.oriented.jpg": b"z", "abc/DG12/g.pdf": b"z", "h.jpg": b"z",
    }
    for name, content in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = filetree.scan_files(spark, str(tmp_path))
    assert sorted((r.application_no, r.material, r.name) for r in found.collect()) == [("1", "id_back", "2024_1_d.png"), ("1", "id_front", "2024_1_a.jpg"), ("1", "id_front", "2024_1_b.JPG"), ("abc", "id_front", "g.pdf")]
    good, bad = filetree.known_applications(found)
    assert good.count() == 3 and [r.application_no for r in bad.collect()] == ["abc"]
    numbered = good.selectExpr("application_no", "material", "name", "digest", "length AS file_id")
    assert files.dedupe_files(numbered).count() == 2
