import os

from codeatlas.sources import files


def test_wide_deep_and_flat_folders(spark, tmp_path):
    """A chain of 300 folders, 200 side by side, and 20,000 files in one: all found, in rounds."""
    deep = tmp_path
    for k in range(300):
        deep = deep / f"d{k % 10}"
    os.makedirs(deep)
    (deep / "last.py").write_text("x")
    for k in range(200):
        (tmp_path / f"wide{k}" / "in ner").mkdir(parents=True)
        (tmp_path / f"wide{k}" / "in ner" / f"_é{k}.py").write_text("xy")
    (tmp_path / "flat").mkdir()
    for k in range(20_000):
        (tmp_path / "flat" / f"{k}").touch()
    (tmp_path / "empty").mkdir()
    got = {r["path"]: r["size_bytes"] for r in files.list_files(spark, str(tmp_path), share=40).collect()}
    want = {os.path.relpath(os.path.join(a, f), tmp_path): os.path.getsize(os.path.join(a, f)) for a, _, names in os.walk(tmp_path) for f in names}
    assert got == want and len(got) == 20_201


def test_empty_folder(spark, tmp_path):
    assert files.list_files(spark, str(tmp_path)).count() == 0
