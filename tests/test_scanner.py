"""Scanner behaviour on real folder trees."""

import pytest

from lintel.sources.files import scan_sources


def write(root, rel, text="x = 1\n"):
    p = root / rel
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)


def names(df):
    return sorted(r.file_path.rsplit("/", 1)[-1] for r in df.collect())


def test_finds_python_files_recursively_and_prunes(spark, tmp_path):
    write(tmp_path, "a.py")
    write(tmp_path, "notes.txt")
    write(tmp_path, "pkg/sub/b.py", "if x:\n    pass\n")
    write(tmp_path, "venv/lib/c.py")
    write(tmp_path, "__pycache__/d.py")
    write(tmp_path, ".git/hooks/e.py")
    write(tmp_path, "build/f.py")
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe\x00bad")
    df = scan_sources(spark, str(tmp_path))
    assert names(df) == ["a.py", "b.py"]


def test_empty_directory(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert scan_sources(spark, str(tmp_path / "empty")).count() == 0


def test_missing_root_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        scan_sources(spark, str(tmp_path / "nope"))
