"""Text in, text out, through the whole pipeline."""

import pytest

from pairweave.plans.cluster import ClusterOptions, cluster
from pairweave.sources.pairs import header_of, read_objects, read_pairs, write_single_file

PAIRS = "name1\tname2\tid1\tid2\tsim\np\tq\t8\t4\t0.91\nq\tr\t4\t5\t0.88\nm\tk\t1\t2\t0.97\nk\tn\t2\t0\t0.75\ns\tt\t6\t7\t0.30\nu\tp\t3\t8\t0.72"
LIST = "object,length\nn,1\nm,1\nk,1\nu,1\nq,1\nr,1\ns,1\nt,1\np,1\nz,1\n"
# (numeric ids, object list, representatives) -> rows
WANT = {
    (0, 0, 0): "p 0 q 0 r 0 u 0 k 1 m 1 n 1",
    (0, 0, 1): "p p q p r p u p k k m k n k",
    (1, 0, 0): "3 0 4 0 5 0 8 0 0 1 1 1 2 1",
    (1, 0, 1): "3 3 4 3 5 3 8 3 0 0 1 0 2 0",
    (0, 1, 0): "u 0 q 0 r 0 p 0 n 1 m 1 k 1 s 2 t 3 z 4",
    (0, 1, 1): "u u q u r u p u n n m n k n s s t t z z",
    (1, 1, 0): "u 0 q 0 r 0 p 0 n 1 m 1 k 1 s 2 t 3 z 4",
    (1, 1, 1): "u u q u r u p u n n m n k n s s t t z z",
}


@pytest.mark.parametrize("case", WANT)
def test_single_linkage(spark, tmp_path, case):
    numeric, listed, reps = map(bool, case)
    (tmp_path / "pairs").write_text(PAIRS)
    (tmp_path / "list").write_text(LIST)
    # the order in which id columns are named doesn't matter
    options = ClusterOptions(id_cols=("id2", "id1") if numeric else ("name1", "name2"), distance_col="sim", kind="similarity", minimum={"sim": 0.70}, numeric_ids=numeric, representatives=reps)
    options = options.resolve(header_of(spark, str(tmp_path / "pairs")))
    table, order = read_pairs(spark, str(tmp_path / "pairs"), id_cols=options.id_cols, distance_col="sim", numeric_ids=numeric)
    objects = read_objects(spark, str(tmp_path / "list")) if listed else None
    write_single_file(cluster(table, objects=objects, order=order, options=options), str(tmp_path / "out"), csv=True)
    rows = (tmp_path / "out").read_text().split("\n")
    assert rows[0] == "object,cluster"
    assert " ".join(r.replace(",", " ") for r in rows[1:] if r) == WANT[case]
