from collections import defaultdict

from pagewatch.catalog import query

FOLDER = "/root/testdata/sf0.01"


def test_twins_of_every_detection(spark):
    """Each detection's twins, spelled out from bodies and claims, are those of a plain comparison; ids are not picked."""
    listed, got = defaultdict(set), {}
    for r in query("twins_of")(spark, FOLDER).collect():
        got[r.asked_id] = r
        listed[r.body_id].add(r.asked_id)
    bodies = defaultdict(list)
    for r in query("cross_attribution_twins")(spark, FOLDER).select("text_hash", "detection_id", "candidate_id").collect():
        bodies[r.text_hash].append((r.detection_id, r.candidate_id))
    asked = 0
    for members in bodies.values():
        for one, who in members[::17]:
            want = {other for other, owner in members if owner != who}
            found = {other for other in listed[got[one].body_id] if got[other].claim_id != got[one].claim_id}
            assert found == want and got[one].n_twins == len(want)
            asked += 1
    assert asked and len(got) == sum(map(len, bodies.values()))
    assert any(one % 20 for one in got)
