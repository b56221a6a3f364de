"""A mailing that is killed at any step and run again."""

import pytest
from pyspark.sql import functions as F

from tidewell.plans import mailing
from tidewell.sources import keyed

MAILS = [(f"k{i}", f"body {i}") for i in range(30)] + [("k3", "body 3"), (None, "nobody")]


class Receiver:
    """Counts deliveries by key; breaks before or after delivering a call."""

    def __init__(self, broken=None, after=False):
        self.seen, self.calls, self.broken, self.after = {}, 0, broken, after

    def __call__(self, claimed):
        self.calls += 1
        if self.calls == self.broken and not self.after:
            raise ConnectionError
        for r in claimed.collect():
            self.seen.setdefault(r["key"], []).append(r["body"])
        if self.calls == self.broken:
            raise ConnectionError
        return claimed.filter("key <> 'k5'").select("key", F.lit("sent").alias("status"))


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("broken", [1, 2, 3])
def test_a_killed_run_goes_on(spark, tmp_path, broken, after):
    mails = spark.createDataFrame(MAILS, "key string, body string")
    receiver, path = Receiver(broken, after), str(tmp_path / "ledger")
    with pytest.raises(ConnectionError):
        mailing.send_slices(mails, path, receiver, 3)
    changed = mails.withColumn("body", F.concat("body", F.lit(" as planned later")))  # what was claimed is sent as it was claimed
    mailing.send_slices(changed, path, receiver, 3)
    ledger = {r["key"]: (r["status"], r["body"]) for r in keyed.read(spark, path).collect()}
    assert ledger.keys() == receiver.seen.keys() == {k for k, _ in MAILS if k}
    assert {k for k, (s, _) in ledger.items() if s != "sent"} == {"k5"}
    for key, bodies in receiver.seen.items():  # repeats only of the slice that broke off after delivery, and alike
        assert set(bodies) == {ledger[key][1]} and (len(bodies) == 1 or after)
    calls = receiver.calls
    mailing.send_slices(changed, path, receiver, 3)
    assert receiver.calls == calls and {r["status"]: r["n"] for r in keyed.read_counts(spark, path).collect()} == {"sent": 29, "failed": 1}


def test_no_mail(spark, tmp_path):
    mailing.send_slices(spark.createDataFrame([], "key string, body string"), str(tmp_path / "ledger"), Receiver(), 2)
    assert keyed.manifest(spark, str(tmp_path / "ledger")) is None
