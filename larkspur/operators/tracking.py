"""Multi-object tracking: association within a clip in Python, everything around it relational.

A clip is one event's recording and is tracked as one group; clips are dealt out over the cluster. A tracker's state holds what
association looks at, and every sample of its tracks unless ``forget`` shortens them (as the live tracker does).
Track ids count up within the clip or the live stream, so results repeat exactly.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import geo
from larkspur.operators import temporal
from larkspur.session import shared_folder

# Fixed values of the tracker's gates.
MATCH_IOU, BLOCK_IOU, NMS_IOU = 0.20, 0.45, 0.50
GRACE, SPAWN = 8, 0.50
EDGE_PX, EDGE_GRACE = 8, 2
REVIVE_S, REVIVE_DISTANCE, REVIVE_RATIO, REVIVE_FREE, REVIVE_MEMORY = 12.0, 1.6, 1.7, 0.2, 32
MERGE_IOU, MERGE_BOXES = 0.6, 3
FADE, FADE_FLOOR = 0.7, 0.05
VOTES, VELOCITY_SAMPLES, STILL, MAX_SHIFT, DECAY = 5, 6, 0.05, 0.4, 6
STITCH_S, STITCH_DISTANCE, STITCH_RATIO, STITCH_OVERLAP = 6.0, 1.6, 1.8, 0.55
GHOST_SCORE = 0.55
SCHEMA = "clip string, track_id int, f int, t double, x1 double, y1 double, x2 double, y2 double, score double, label string, source string"
LISTED = "of string, place int, nth int"  # a track's label, its place among a clip's tracks as they ended, and the sample's place in it

Box = tuple[float, float, float, float]
Sample = tuple[int, float, Box, float, str, str]  # frame, seconds, box, score, label, source


def box_iou(a: Box, b: Box) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    both = w * h
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def centre(b: Box) -> tuple[float, float]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def _apart(a: Box, b: Box) -> float:
    (ax, ay), (bx, by) = centre(a), centre(b)
    return ((ax - bx) ** 2 + (ay - by) ** 2) ** 0.5


def _sides(b: Box) -> tuple[float, float]:
    return b[2] - b[0], b[3] - b[1]


def _ratio(a: Box, b: Box) -> float:
    """How many times as wide or as high the larger of two boxes is, whichever is more; sides count as a pixel at least."""
    return max(max(x, y, 1.0) / max(min(x, y), 1.0) for x, y in zip(_sides(a), _sides(b), strict=True))


@dataclass(eq=False)
class Track:
    number: int
    label: str
    samples: list[Sample] = field(default_factory=list)
    seen: list[Sample] = field(default_factory=list)  # those of them that are detections
    hits: int = 0
    best: float = 0.0
    first: int = 0
    missed: int = 0
    motion: tuple | None = None  # of the detections so far: their median velocity, if they move

    @property
    def box(self) -> Box:
        return self.samples[-1][2]

    def predicted(self, f: int) -> Box:
        """GEO-12: the last detection's box, moved by the median velocity per frame; it stays where the subject hardly moves.

        The move fades with the frames since then and is at most ``MAX_SHIFT`` of the box's side. A track with one detection stays at its last sample.
        """
        if len(self.seen) < 2:
            return self.box
        if self.motion is None:
            self.motion = self._velocity()
        at, _, box, *_ = self.seen[-1]
        if not self.motion:
            return box
        sides = _sides(box)
        ahead = max(0, f - at)
        ahead *= max(0.0, 1 - ahead / DECAY)
        moved = []
        for middle, side, along in zip(centre(box), sides, self.motion, strict=True):
            step = along * ahead
            moved.append(middle + max(-MAX_SHIFT * side, min(MAX_SHIFT * side, step)))
        (x, y), (w, h) = moved, sides
        return tuple(float(int(v)) for v in (x - w / 2, y - h / 2, x + w / 2, y + h / 2))  # whole pixels, towards zero

    def _velocity(self) -> tuple:
        """Median velocity per frame over the last detections; none where the subject hardly moves."""
        speeds = []
        for p, q in itertools.pairwise(self.seen[-VELOCITY_SAMPLES:]):
            (px, py), (qx, qy), frames = centre(p[2]), centre(q[2]), max(1, q[0] - p[0])
            speeds.append(((qx - px) / frames, (qy - py) / frames))
        if sum((x * x + y * y) ** 0.5 for x, y in speeds) / len(speeds) < STILL * max(1.0, min(_sides(self.seen[-1][2]))):
            return ()
        return tuple(sorted(along)[len(along) // 2] for along in zip(*speeds, strict=True))

    def add(self, f: int, t: float, det: tuple) -> None:
        """A detection: it ends a miss and votes for the label, which changes only to one with strictly more of the last votes."""
        label, score, b = det
        sample = (f, t, b, round(score, 4), label, "detect")
        self.samples.append(sample)
        self.seen.append(sample)
        self.motion = None
        self.hits, self.best, self.missed = self.hits + 1, max(self.best, score), 0
        if len(self.seen) == 1 and label == self.label:
            return
        votes = [s[4] for s in reversed(self.seen[-VOTES:])]
        top = max(dict.fromkeys(votes), key=votes.count)
        if votes.count(top) > votes.count(self.label):
            self.label = top

    def miss(self, f: int, t: float, b: Box) -> None:
        self.samples.append((f, t, b, max(FADE_FLOOR, FADE * self.seen[-1][3]), self.label, "predicted"))
        self.missed += 1

    def absorb(self, other: Track) -> None:
        """The other's samples on frames that this one has none of."""
        self.motion, mine = None, {s[0] for s in self.samples}
        for have, more in ((self.samples, other.samples), (self.seen, other.seen)):
            fresh = [s for s in more if s[0] not in mine]
            later = not have or not fresh or have[-1][0] <= fresh[0][0]
            have += fresh
            if not later:
                have.sort(key=lambda s: s[0])
        self.hits += sum(s[0] not in mine for s in other.seen)
        self.best, self.first = max(self.best, other.best), min(self.first, other.first)


class Finished(Track):
    """A track of a finished clip, with all its samples: its best score is one that it has a sample of."""

    def absorb(self, other: Track) -> None:
        best = self.best
        super().absorb(other)
        self.best = max(best, *(s[3] for s in self.samples))


@dataclass
class Tracker:
    """Tracks that are alive, those that have ended, the next track's number, and the frames so far of a live stream."""

    active: list[Track] = field(default_factory=list)
    closed: list[Track] = field(default_factory=list)
    following: int = 0
    frames: int = 0

    def tracks(self) -> list[Track]:
        return sorted([*self.active, *self.closed], key=lambda x: x.number)


def suppress(dets: list[tuple]) -> list[tuple]:
    """TRK-1: greedy suppression within a label; labels in their first order, the best of a label first."""
    if len(dets) == 1:
        return dets
    out: list[tuple] = []
    for label in dict.fromkeys(d[0] for d in dets):
        kept: list[tuple] = []
        for d in sorted((d for d in dets if d[0] == label), key=lambda d: -d[1]):
            if all(box_iou(d[2], k[2]) <= NMS_IOU for k in kept):
                kept.append(d)
        out += kept
    return out


def _at_edge(b: Box, frame: tuple[int, int]) -> bool:
    w, h = frame
    return w > 0 and h > 0 and (b[0] <= EDGE_PX or b[1] <= EDGE_PX or b[2] >= w - EDGE_PX or b[3] >= h - EDGE_PX)


def _inside(b: Box, frame: tuple[int, int]) -> Box:
    """The box cut to the frame, where its size is known."""
    if frame == (0, 0):
        return b
    limit = [max(0, size) or None for size in (*frame, *frame)]
    return tuple(v if most is None else float(max(0, min(most, v))) for v, most in zip(b, limit, strict=True))


def associate(state: Tracker, dets: list[tuple], f: int, t: float, spawn: dict[str, float] | None = None, grace: int = GRACE, frame: tuple[int, int] = (0, 0)) -> None:
    """One frame: dets are (label, score, box). The state is changed in place."""
    dets, t, spawn = suppress(dets), round(t, 3), spawn or {}
    sure = [d[1] >= spawn.get(d[0], SPAWN) for d in dets]
    active = list(state.active)  # those of before this frame
    ahead = {x.number: x.predicted(f) for x in active}
    hit: set[int] = set()
    used: set[int] = set()
    for tier in (True, False):  # TRK-2/3: the sure ones choose first
        pairs = [(-share, i, j) for i, d in enumerate(dets) if sure[i] == tier for j, x in enumerate(active) if d[0] == x.label and x.number not in hit and (share := box_iou(ahead[x.number], d[2])) >= MATCH_IOU]
        for _, i, j in sorted(pairs):
            if i not in used and active[j].number not in hit:
                used.add(i)
                hit.add(active[j].number)
                active[j].add(f, t, dets[i])
    for i, d in enumerate(dets):
        if i in used or not sure[i]:
            continue
        # TRK-4: on top of a track that is alive a sure detection joins it, whatever its label and even if it has one already.
        near = []
        for j, x in enumerate(state.active):
            box, share = x.box, box_iou(d[2], x.box)
            if (moved := ahead.get(x.number, box)) is not box:
                share = max(share, box_iou(d[2], moved))
            if share > BLOCK_IOU:
                near.append((share, -j))
        if near:
            x = state.active[-max(near)[1]]
        elif (x := _revived(state, d, t)) is not None:  # TRK-5
            state.closed.remove(x)
            state.active.append(x)
        else:  # TRK-6
            x = Track(state.following, d[0], first=f)
            state.following += 1
            state.active.append(x)
        hit.add(x.number)
        x.add(f, t, d)
    for x in active:  # TRK-7
        if x.number not in hit:
            x.miss(f, t, _inside(ahead[x.number], frame))
            if x.missed >= max(1, min(grace, EDGE_GRACE) if _at_edge(x.seen[-1][2], frame) else grace):
                state.active.remove(x)
                state.closed.append(x)
    _merge(state)  # TRK-8


def _revived(state: Tracker, det: tuple, t: float) -> Track | None:
    """The nearest of the last closed tracks that the detection can be, unless a live one is in its place."""
    if any(box_iou(det[2], x.box) > REVIVE_FREE for x in state.active):
        return None
    fits = []
    for nth, x in enumerate(reversed(state.closed[-REVIVE_MEMORY:])):
        if x.label != det[0] or t - x.samples[-1][1] > REVIVE_S:
            continue
        far = _apart(det[2], x.box)
        if far <= REVIVE_DISTANCE * max(1.0, *_sides(x.box)) and _ratio(det[2], x.box) <= REVIVE_RATIO:
            fits.append((far, nth, x))
    return min(fits, key=lambda c: c[:2])[2] if fits else None


def _merge(state: Tracker) -> None:
    """Two live tracks of a label whose last detections coincide become the better one; the other one ends."""
    for a, b in itertools.combinations([x for x in state.active if len(x.seen) >= MERGE_BOXES], 2):
        if a not in state.active or b not in state.active or a.label != b.label:
            continue
        tails = a.seen[-MERGE_BOXES:], b.seen[-MERGE_BOXES:]
        if any(box_iou(p[2], q[2]) < MERGE_IOU for p, q in zip(*tails, strict=True)):
            continue
        rank = [(100 * x.hits + 10 * x.best, -x.first) for x in (a, b)]
        winner, loser = (b, a) if rank[1] > rank[0] else (a, b)
        winner.absorb(loser)
        state.active.remove(loser)
        state.closed.append(loser)


def forget(state: Tracker) -> None:
    """Shorten the state to what association can still look at: live tracks, the last closed ones, the latest detections and sample of each."""
    state.closed = state.closed[-REVIVE_MEMORY:]
    for x in [*state.active, *state.closed]:
        x.seen, x.samples = x.seen[-VELOCITY_SAMPLES:], x.samples[-1:]


def stitched(tracks: list[Track]) -> list[Track]:
    """TRK-10/JN-11: tracks of a finished clip, where a later track that goes on where an earlier one ended has become part of it,

    and then tracks that were mostly in the same place on the frames they share. Each step repeats until nothing changes.
    """
    live = [x for x in tracks if x.seen]
    while True:
        live.sort(key=lambda x: x.seen[0][1])
        kept: list[Track] = []
        ended: dict[str, list[Track]] = {}  # of a label, those that a track still to come can go on
        for b in live:
            start = b.seen[0][1]
            recent = ended[b.label] = [a for a in ended.get(b.label, ()) if start - a.seen[-1][1] <= STITCH_S]
            before = [(gap, i) for i, a in enumerate(recent) if (gap := _gap(a, b)) is not None]
            if before:
                recent[min(before)[1]].absorb(b)
            else:
                kept.append(b)
                recent.append(b)
        done, live = len(kept) == len(live), kept
        if done:
            break
    return _united(live)


def _united(live: list[Track]) -> list[Track]:
    """Tracks of a label that mostly overlap on shared frames as one."""
    return [live[places[0]] for places in _unions(live)]


def _unions(live: list[Track], least: float = STITCH_OVERLAP) -> list[list[int]]:
    """Tracks of a label that overlap on average by ``least`` on shared frames become one, always the first pair in the list's order, until none do. The better one absorbs the other.

    Gives the places of those that became one, in the order in which they come first on a frame. An average that high needs such an overlap on some frame, so only tracks with one are
    compared, and after a merge only the pairs of the track that grew: what it has on a frame was there before.
    """
    near = _beside(live, least)
    grown, became, waiting = [0] * len(live), {i: [i] for i in range(len(live))}, []

    def offer(i: int, others: set[int]) -> None:
        for p, q in ((min(i, j), max(i, j)) for j in others):
            if _shared_overlap(live[p], live[q]) >= least:
                heapq.heappush(waiting, (p, q, grown[p], grown[q]))

    for i in range(len(live)):
        offer(i, {j for j in near[i] if j > i})
    while waiting:
        p, q, of_p, of_q = heapq.heappop(waiting)
        if p not in became or q not in became or (grown[p], grown[q]) != (of_p, of_q):
            continue
        into, other = sorted((p, q), key=lambda i: (-live[i].hits, -live[i].best))
        live[into].absorb(live[other])
        became[into] += became.pop(other)
        grown[into] += 1
        for j in near[other]:
            near[j].discard(other)
            near[j].add(into)
        near[into] = (near[into] | near[other]) - {into, other}
        offer(into, near[into])
    return list(became.values())


def _beside(live: list[Track], least: float) -> list[set[int]]:
    """For each track those of its label that overlap it by ``least`` on some frame: along a frame's boxes from the left, as far as one can overlap that much."""
    at: dict[tuple, list[tuple]] = {}
    for i, x in enumerate(live):
        for s in x.seen:
            at.setdefault((x.label, s[0]), []).append((*s[2], i))
    near: list[set[int]] = [set() for _ in live]
    slack = 1e-9  # averages are rounded
    for boxes in at.values():
        boxes.sort()
        for n, (x1, y1, x2, y2, i) in enumerate(boxes):
            far, most = x1 + (1 - least + slack) * (x2 - x1), (1 - least + slack) * (y2 - y1)
            for m in range(n + 1, len(boxes)):
                b = boxes[m]
                if b[0] > far:
                    break
                if b[1] - y1 <= most and i != b[4] and box_iou((x1, y1, x2, y2), b[:4]) >= least * (1 - slack):
                    near[i].add(b[4])
                    near[b[4]].add(i)
    return near


def _gap(a: Track, b: Track) -> float | None:
    """Seconds from the end of a to the start of b, if b can go on as a."""
    end, start = a.seen[-1], b.seen[0]
    gap = start[1] - end[1]
    near = _apart(end[2], start[2]) <= STITCH_DISTANCE * max(*_sides(end[2]), *_sides(start[2]))
    return gap if a.label == b.label and 0 <= gap <= STITCH_S and near and _ratio(end[2], start[2]) <= STITCH_RATIO else None


def _shared_overlap(a: Track, b: Track) -> float:
    """Mean overlap of two tracks' detections on the frames that both have."""
    of = {s[0]: s[2] for s in a.seen}
    shares = [box_iou(of[f], box) for f, box in {s[0]: s[2] for s in b.seen}.items() if f in of]
    return sum(shares) / len(shares) if shares else 0.0


def track_clip(rows: Iterator[tuple] | list[tuple], whole: bool = False, frame: tuple[int, int] = (0, 0), listed: bool = False) -> list[tuple]:
    """All tracks' samples of a clip from its detections (f, t, label, score, x1, y1, x2, y2), sorted by frame; stitched if ``whole``, with the columns of ``LISTED`` if ``listed``."""
    state = Tracker()
    for f, seen in itertools.groupby(rows, key=lambda r: r[0]):
        dets = list(seen)
        associate(state, [(r[2], r[3], tuple(float(int(v)) for v in r[4:8])) for r in dets], f, dets[0][1], frame=frame)
    place = {x.number: i for i, x in enumerate([*state.closed, *state.active])}
    tracks = stitched(state.tracks()) if whole else state.tracks()
    more = lambda x, nth: (x.label, place[x.number], nth) if listed else ()
    return [(x.number, s[0], s[1], *s[2], s[3], s[4], s[5], *more(x, nth)) for x in sorted(tracks, key=lambda x: x.number) for nth, s in enumerate(x.samples)]


_KINDS = (pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 6, pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
_NAMES = [c.split()[0] for c in f"{SCHEMA}, {LISTED}".split(", ")]


def track(detections: DataFrame, whole: bool = False, frame: tuple[int, int] = (0, 0), listed: bool = False) -> DataFrame:
    """TRK-1..8 for every clip, and TRK-10's stitching if ``whole``. Rows come sorted by clip, and one clip at a time is held.

    ``frame`` is the picture's width and height, if known: boxes are then kept inside, and a subject at the edge is given up soon. ``listed`` adds the columns of ``LISTED``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for clip, part in itertools.groupby(rows, key=lambda r: r[0]):
            out = track_clip((r[1:] for r in part), whole, frame, listed)
            for at in range(0, len(out), 8192):
                yield _batch(clip, out[at : at + 8192])

    cut = detections.select("clip", "f", "t", "label", "score", "x1", "y1", "x2", "y2").repartition("clip")
    return cut.sortWithinPartitions("clip", "f", "label", F.desc("score"), "x1", "y1", "x2", "y2", "t").mapInArrow(run, f"{SCHEMA}, {LISTED}" if listed else SCHEMA)


def once(rows: DataFrame, tag: str = "tracks") -> DataFrame:
    """The rows, written once to the shared folder: what reads tracks several times then doesn't track several times."""
    folder = shared_folder(rows.sparkSession, tag)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _batch(clip: str | None, rows: list[tuple]) -> pa.RecordBatch:
    clips = pa.repeat(pa.scalar(clip, _KINDS[0]), len(rows))
    columns = [clips, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS[1:], strict=False))]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES[: len(columns)])


def best_moments(samples: DataFrame) -> DataFrame:
    """TRK-9: the best detection of each clip, the first of equals."""
    seen = samples.where("source = 'detect'")
    return seen.groupBy("clip").agg(F.min(F.struct((-F.col("score")).alias("less"), "f", "t", "label")).alias("b")).select("clip", "b.f", "b.t", "b.label", (-F.col("b.less")).alias("score"))


def summaries(samples: DataFrame) -> DataFrame:
    """AGG-13: label, span, hits and best score of each track."""
    seen = F.col("source") == "detect"
    return samples.groupBy("clip", "track_id").agg(F.max_by("label", "f").alias("label"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count_if(seen).alias("hits"), F.max(F.when(seen, F.col("score"))).alias("best"))


def keep_real(samples: DataFrame, spawn: float = GHOST_SCORE, n: int = 3, secs: float = 5.0) -> DataFrame:
    """TRK-11: without ghosts: the best score reaches the spawn score, or n detections lie within ``secs``."""
    known = summaries(samples)
    confirmed = temporal.confirm_clip(samples.where("source = 'detect'"), ["clip", "track_id"], "t", n, secs)
    real = known.join(confirmed, ["clip", "track_id"]).where((F.col("best") >= spawn) | F.col("confirmed")).select("clip", "track_id")
    return samples.join(real, ["clip", "track_id"], "left_semi")


def without_static(samples: DataFrame, spawn: float = GHOST_SCORE, share: float = 0.5) -> DataFrame:
    """TRK-10/WIN-23: without tracks whose detections are mostly fainter than the spawn score and hardly move for their size."""
    still = temporal.static_false_positive(samples.where("source = 'detect'"), ["clip", "track_id"], "f", spawn, share).where("static")
    return samples.join(still.select("clip", "track_id"), ["clip", "track_id"], "left_anti")


def stitch_candidates(samples: DataFrame, gap: float = STITCH_S, reach: float = STITCH_DISTANCE, ratio: float = STITCH_RATIO) -> DataFrame:
    """JN-11: for each track the earlier track of its clip and label that ended last before it began, at most ``gap`` seconds, close by and of like size."""
    box = F.struct("x1", "y1", "x2", "y2")
    ends = samples.where("source = 'detect'").groupBy("clip", "track_id").agg(F.max_by("label", "f").alias("label"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.min_by(box, "f").alias("head"), F.max_by(box, "f").alias("tail"))
    a = ends.select("clip", "label", F.col("track_id").alias("before"), "t1", "tail")
    b = ends.select("clip", "label", "track_id", "t0", "head")
    side = lambda c, k: F.col(f"{c}.{k}2") - F.col(f"{c}.{k}1")
    like = F.lit(True)
    for k in "xy":
        like = like & (F.greatest(side("head", k), side("tail", k), F.lit(1.0)) / F.greatest(F.least(side("head", k), side("tail", k)), F.lit(1.0)) <= ratio)
    near = geo.centroid_distance(F.col("head"), F.col("tail")) <= reach * F.greatest(*[side(c, k) for c in ("head", "tail") for k in "xy"])
    wait = F.col("t0") - F.col("t1")
    pairs = b.join(a, ["clip", "label"]).where((F.col("track_id") != F.col("before")) & wait.between(0, gap) & near & like)
    pairs = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("clip", "track_id").orderBy(wait, "before"))).where("nth = 1")
    return pairs.select("clip", "track_id", "before", wait.alias("wait"))


def mean_overlap(samples: DataFrame) -> DataFrame:
    """JN-12: mean overlap of each two tracks of a label on the frames they share."""
    box = F.struct("x1", "y1", "x2", "y2")
    seen = samples.where("source = 'detect'")
    a = seen.select("clip", "label", "f", F.col("track_id").alias("a"), box.alias("box_a"))
    b = seen.select("clip", "label", "f", F.col("track_id").alias("b"), box.alias("box_b"))
    return a.join(b, ["clip", "label", "f"]).where("a < b").groupBy("clip", "a", "b").agg(F.avg(geo.iou(F.col("box_a"), F.col("box_b"))).alias("overlap"), F.count("*").alias("frames"))


def reindex_plan(events: DataFrame, sidecars: DataFrame, version: int = 4) -> DataFrame:
    """TRK-12: events whose sidecar is missing or of another version."""
    both = events.select("event_id").join(sidecars.select("event_id", "schema"), "event_id", "left")
    return both.where(F.col("schema").isNull() | (F.col("schema") != version)).select("event_id", F.when(F.col("schema").isNull(), "missing").otherwise("stale").alias("why"))


def at_time(samples: DataFrame, t: float, slack: float = 0.05) -> DataFrame:
    """JN-20/WIN-31: every track's box at a time, interpolated between the samples around it; none outside its detections."""
    s = F.struct("t", "x1", "y1", "x2", "y2", "score")
    out = samples.groupBy("clip", "track_id").agg(
        F.min("t").alias("t0"), F.max(F.when(F.col("source") == "detect", F.col("t"))).alias("t1"), F.max(F.when(F.col("t") <= t, s)).alias("a"), F.min(F.when(F.col("t") >= t, s)).alias("b")
    )
    out = out.where((F.col("t0") - slack <= t) & (F.col("t1") + slack >= t)).withColumns({"a": F.coalesce("a", "b"), "b": F.coalesce("b", "a")})
    w = F.when(F.col("b.t") > F.col("a.t"), (F.lit(t) - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))).otherwise(0.0)
    return out.select("clip", "track_id", *[(F.col(f"a.{k}") + w * (F.col(f"b.{k}") - F.col(f"a.{k}"))).alias(k) for k in ("x1", "y1", "x2", "y2")])


def merge_overlapping(samples: DataFrame, least: float = STITCH_OVERLAP) -> DataFrame:
    """TRK-10: tracks of a label that overlap on average by ``least`` on the frames where both were detected become one; then what that made is compared again, until no two do.

    Pairs go in the order of the clip's tracks. The one with more detections goes on, of equals that with the better one, then the earlier, and takes from the other what it has no sample of at that frame.
    With the columns of ``LISTED`` that order, the tracks' labels and the order of a track's samples are as the tracker left them; without, they are the track's number, its last sample's label and the
    better sample last. An average that high needs such an overlap on some frame, so only tracks with one are gone through, a clip at a time; the samples are joined with what comes of it.
    """
    extra, key = [c.split()[0] for c in LISTED.split(", ")], ["clip", "track_id"]
    plain = [c for c in samples.columns if c not in extra]
    listed = samples
    if not set(extra) <= set(samples.columns):
        last = F.max_by("label", F.struct("f", "score", "label")).over(Window.partitionBy(*key))
        listed = samples.withColumns({"of": last, "place": F.col("track_id"), "nth": F.lit(0)})
    own = lambda rows: rows.withColumnsRenamed({k: f"of_{k}" for k in key})
    same = F.col("clip").eqNullSafe(F.col("of_clip")) & (F.col("track_id") == F.col("of_track_id"))
    cut = listed.join(own(once(_overlapped(listed, least), "beside")), same, "left_semi").select("clip", "place", "track_id", "f", "nth", "score", "x1", "y1", "x2", "y2", "source", "of")
    merges = once(cut.repartition("clip").sortWithinPartitions(*cut.columns[:-1]).mapInArrow(_merged(least), "of_clip string, of_track_id int, into int, rank int"), "merged")
    first = F.min("rank").over(Window.partitionBy("clip", "into", "f"))
    grown = samples.join(merges, same).withColumn("first", first).where("rank = first").withColumn("track_id", F.col("into"))
    return samples.join(merges, same, "left_anti").select(*plain).unionByName(grown.select(*plain))


def _overlapped(listed: DataFrame, least: float) -> DataFrame:
    """``(clip, track_id)`` of the tracks that another one of their label overlaps by ``least`` on some frame; a little less, as averages are rounded."""
    box = F.struct("x1", "y1", "x2", "y2")
    seen = listed.where("source = 'detect'").select("clip", "of", "f", "track_id", box.alias("box"))
    other = seen.withColumnsRenamed({c: f"{c}_b" for c in seen.columns})
    frame = F.col("clip").eqNullSafe(F.col("clip_b")) & (F.col("of") == F.col("of_b")) & (F.col("f") == F.col("f_b"))
    met = seen.join(other, frame & (F.col("track_id") < F.col("track_id_b"))).where(geo.iou(F.col("box"), F.col("box_b")) >= least * (1 - 1e-9))
    return met.select("clip", F.explode(F.array("track_id", "track_id_b")).alias("track_id")).distinct()


def _merged(least: float):  # noqa: ANN202
    """What gives, for sorted samples of whole clips, the tracks that became one: each with the one that goes on and its turn on a frame that several have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for clip, part in itertools.groupby(rows, key=lambda r: r[0]):
            tracks = []
            for number, own in itertools.groupby(part, key=lambda r: r[2]):
                x = Finished(number, "")
                for *_, f, _nth, score, x1, y1, x2, y2, source, x.label in own:
                    x.samples.append((f, 0.0, (x1, y1, x2, y2), score or 0.0, x.label, source))
                x.seen = [s for s in x.samples if s[5] == "detect"]
                x.hits, x.best = len(x.seen), max(s[3] for s in x.samples)
                tracks.append(x)
            found = [(tracks[i].number, tracks[places[0]].number, rank) for places in _unions(tracks, least) if len(places) > 1 for rank, i in enumerate(places)]
            if found:
                columns = [pa.repeat(pa.scalar(clip, pa.string()), len(found)), *(pa.array(c, pa.int32()) for c in zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=["of_clip", "of_track_id", "into", "rank"])

    return run
