"""Repetition of icons against plain arithmetic."""

import random

from boxloom.plans.repetition import row_repetition, with_repetition

ICON = "page_id bigint, media_id bigint, region_id bigint, x bigint, y bigint, w bigint, h bigint"


def plain(icons):
    centers = [y + h / 2 for _, _, _, _, y, _, h in icons]
    middle = sorted(i[6] for i in icons)[len(icons) // 2]
    level = round(max(0.0, 1.0 - (max(centers) - min(centers)) / max(1.0, middle * 1.5)), 3)
    across = sorted(x + w / 2 for _, _, _, x, _, w, _ in icons)
    gaps = [b - a for a, b in zip(across, across[1:])]
    if len(icons) == 2:
        even = 0.65
    else:
        mean = sum(gaps) / len(gaps)
        even = round(max(0.0, 1.0 - (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5 / mean), 3) if mean > 0 else 0.0
    return round((level + even) / 2, 3)


def test_scores_of_media(spark):
    r, media = random.Random(4), {}
    for page in range(6):
        for medium in range(4):
            n = r.choice([1, 2, 3, 8, 40])
            media[page, medium] = [(page, medium, 100 * medium + i, r.choice([0, 70, 70 * i + r.randrange(9)]), 50 + r.randrange(12), r.choice([20, 21]), r.choice([20, 24])) for i in range(n)]
    rows = [i for m in media.values() for i in m]
    got = {(q.page_id, q.media_id): q.repetition for q in row_repetition(spark.createDataFrame(rows, ICON).repartition(4)).collect()}
    want = {k: plain(m) for k, m in media.items() if len(m) > 1}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 0.0011 for k in want)


def test_only_anchored_icons_gain(spark):
    def icon(i, role="internal_icon_candidate", decision="accepted_report_candidate", ocr=1):
        return (1, 1, i, 80 * i, 10, 20, 20, role, decision, ocr, 0.5, 0.5, "medium")

    rows = [icon(0), icon(1), icon(2), icon(3, ocr=None), icon(4, decision="rejected_fragment"), icon(5, role="status_dot_candidate")]
    frame = spark.createDataFrame(rows, ICON + ", role string, decision string, ocr_id bigint, score double, anchor double, confidence string")
    got = {q.region_id: (q.repetition, q.score, q.confidence, q.supported) for q in with_repetition(frame).collect()}
    assert {got[i] for i in (0, 1, 2)} == {(1.0, 0.62, "medium", True)}
    assert {got[i] for i in (3, 4, 5)} == {(None, 0.5, "medium", False)}
