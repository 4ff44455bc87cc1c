import json
import threading
import urllib.error
import urllib.request

from formwright.cli import main
from formwright.console import server


def test_console(spark, tmp_path):
    s = server(spark, "127.0.0.1:0", str(tmp_path), [])
    threading.Thread(target=s.serve_forever, daemon=True).start()
    top = f"http://127.0.0.1:{s.server_address[1]}"

    def call(path, body=None, **headers):
        r = urllib.request.Request(top + path, json.dumps(body).encode() if body is not None else None, {"Content-Type": "application/json"} | headers)
        try:
            with urllib.request.urlopen(r, timeout=120) as got:
                return got.status, json.loads(got.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    text = '{"id":1,"amount":12.5}\n{"id":2,"amount":3.0}\nnot-json'
    assert call("/api/health")[1]["status"] == "ok"
    assert call("/api/infer", {"input": text, "dataset": "x"})[1]["sampled"] == 2
    got = call("/api/shape", {"input": text, "dataset": "x"})[1]
    assert (got["rows_out"], got["parse_errors"]) == (2, 1)
    assert call("/api/inspect", {"path": got["path"]})[1]["rows"] == 2
    assert call("/api/cost", {"rows": 50_000_000, "vendor_per_million": 0.75, "self_host_cost": 12})[1]["saved"] == 25.5
    assert [call("/api/nope")[0], call("/api/infer")[0], call("/api/health", Host="evil.example")[0], call("/api/cost", {}, **{"Content-Type": "text/plain"})[0], call("/api/cost", {})[0]] == [404, 405, 403, 415, 400]
    s.shutdown()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.jsonl").write_text('{"id":1,"s":"new"}\n{"id":2,"s":"new"}\n')
    (tmp_path / "b.jsonl").write_text('{"id":2,"s":"paid"}\n{"id":3,"s":"new"}\n{"id":3,"s":"paid"}\n')
    for name in "ab":
        assert main(["shape", "-i", f"{tmp_path}/{name}.jsonl", "-o", f"{tmp_path}/t", "--to", "iceberg", "--merge-on", "id"]) == 0
    assert "2 key(s) — 1 updated, 1 inserted; 1 prior row(s) replaced" in capsys.readouterr().out
    assert main(["inspect", f"{tmp_path}/t"]) == 0
    assert "live-records: 3 (5 written, 2 removed by position deletes)" in capsys.readouterr().out
    assert main(["shape", "-i", f"{tmp_path}/a.jsonl", "-o", f"{tmp_path}/x.parquet", "--partition-by", "id"]) == 1
    assert main(["cost", "--rows", "4", "--vendor-per-million", "0.75", "--self-host-cost", "0.01"]) == 0
    assert "-333233.3%" in capsys.readouterr().out
