"""Items of linked lines meet by the number of the link, with the results of a plain run over all pairs."""

from collections import Counter

from versionlink.plans import items

INS = "fid long, bid long, path string, line long, address long, instruction string"
FLINK = "old_fid long, old_path string, old_line long, new_fid long, new_path string, new_line long"


def test_items_meet_by_numbers_of_links(spark, monkeypatch):
    blocks = []
    monkeypatch.setattr(items, "closest", lambda a, b, block, *rest, run=items.closest: blocks.append(block) or run(a, b, block, *rest))
    old = [(1, 0, "p", 1, 10, "mov\t%a"), (1, 1, "p", 1, 11, "movl\t%b"), (2, 0, "p", 1, 12, "add\t%a"), (1, 0, "p", 2, 13, "mul\t%c")]
    new = [(5, 0, "q", 1, 20, "movq\t%a"), (6, 0, "q", 1, 21, "movl\t%z"), (5, 1, "q", 1, 22, "and\t%a"), (5, 1, "q", 2, 23, "mull\t%c")]
    # old line 1 of function 1 is linked with line 1 in two functions, once twice; a link without a function meets nothing
    links = [(1, "p", 1, 5, "q", 1), (1, "p", 1, 5, "q", 1), (1, "p", 1, 6, "q", 1), (2, "p", 1, 5, "q", 1), (1, "p", 2, 5, "q", 2), (None, "p", 1, 5, "q", 1)]
    got = items.item_candidates(spark.createDataFrame(old, INS), spark.createDataFrame(new, INS), spark.createDataFrame(links, FLINK))
    rows = Counter((r.old_index, r.new_index) for r in got.collect())
    score = {(r.old_index, r.new_index): r.opcode_match_score for r in got.collect()}
    # movl is best with movl of function 6; movq's best is mov; mov is best with both of them; the link that comes twice counts twice
    assert rows == Counter({(10, 20): 2, (10, 21): 1, (11, 20): 2, (11, 21): 1, (12, 22): 1, (13, 23): 1}) and score[11, 21] == 1.0
    assert score[10, 20] == score[11, 20] == 0.75
    assert blocks == [["link", "oid"]]
