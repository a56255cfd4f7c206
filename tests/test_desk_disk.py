"""What the desk leaves on disk: messages and uploads are packed."""

from lectern.sources import files
from lectern.streaming import desk


def test_packed_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(desk, "folder", lambda spark, kind: f"{tmp_path}/{kind}")
    assert desk.desk_answers(spark, "/root/testdata/sf0.001").where("code = 200").count() > 0
    inbox = list((tmp_path / "desk" / "inbox").glob("part-*"))
    assert inbox and all(p.suffix == ".gz" for p in inbox)
    first = next((tmp_path / "uploads" / "files").glob("*/*/files/*.page.gz"))
    assert first.read_bytes()[:2] == b"\x1f\x8b"
    read = files.read_files(spark, f"{tmp_path}/uploads/files").where(f"name = '{first.name}'").first()
    assert bytes(read.content).startswith(b"BT /F1 11 Tf\n")
