"""Damage to stored files, and leases that expire."""

import glob
import os

from skein.operators import generations


def test_damaged_files_are_named(spark, tmp_path):
    store = generations.Store(str(tmp_path / "g"))
    rows = spark.range(100).withColumnRenamed("id", "n")
    store.publish({"a": rows.repartition(2), "b": rows.selectExpr("n", "n % 2 as part"), "free": rows}, partition_by={"b": "part"}, verified=("a", "b"))
    assert store.damage(spark).count() == 0
    name = store.current()["generation"]
    files = sorted(glob.glob(f"{tmp_path}/g/{name}/a/*.parquet")) + sorted(glob.glob(f"{tmp_path}/g/{name}/b/*/*.parquet"))
    data = bytearray(open(files[0], "rb").read())
    data[len(data) // 2] ^= 1
    with open(files[0], "wb") as f:
        f.write(data)
    os.remove(os.path.join(os.path.dirname(files[0]), f".{os.path.basename(files[0])}.crc"))
    os.remove(files[-1])
    rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/g/{name}/a")
    found = {r["file"]: r["problem"] for r in store.damage(spark).collect()}
    inside = lambda path: path.split(f"/{name}/")[1]
    assert found.pop(inside(files[0])) == "changed" and found.pop(inside(files[-1])) == "missing"
    assert list(found.values()) == ["unexpected"]


def test_expired_leases_hold_nothing(spark, tmp_path):
    now = [1000.0]
    store = generations.Store(str(tmp_path / "g"), keep=1, clock=lambda: now[0])
    publish = lambda n: store.publish({"t": spark.range(n)})["generation"]
    first = publish(1)
    held, dead = store.lease(60), store.lease(10)
    second = publish(2)
    assert {first, second} <= set(store.files.names(""))
    now[0] += 50  # the second lease has run out, the first one is renewed
    assert store.renew(held, 60)
    third = publish(3)
    names = store.files.names("")
    assert first in names and third in names and second not in names
    assert store.files.names(f"leases/{first}") == [held.split("/")[1]] and dead.split("/")[1] not in store.files.names(f"leases/{first}")
    now[0] += 61
    publish(4)
    assert first not in store.files.names("") and not store.renew(held)
