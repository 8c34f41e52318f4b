"""Stateful streams: live census and overdue patients.

Overdue patients come in two forms. `overdue_stream` keeps each patient's moves and due stays in map state, by slots
of event time, and reacts through event-time timers. `overdue_body` runs per micro-batch on DataFrame operators only and
splits every patient id by time, so it also takes a backfill in which one placeholder id holds a third of the rows.
"""

from bisect import bisect_right

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from wardflow.functions import scalar as S
from wardflow.operators import census, scans
from wardflow.session import remove
from wardflow.sources import sinks
from wardflow.streaming.windows import watermarked


def live_census(events, keys=("hospital_id", "dept_id")):
    """Patients present per department, kept across batches (update mode).

    Moves are additive, so this is a built-in sum: combined before the shuffle, one state row per
    department. `moved_at` is the time of the newest move.
    """
    return (census.movements(events).groupBy(*keys)
            .agg(F.sum("delta").alias("net"), F.max("ts").alias("moved_at"))
            .withColumn("census", F.greatest(F.col("net"), F.lit(0))))


OVERDUE_SCHEMA = ("hospital_id string, patient_id string, dept_id string, event_id string, "
                  "arrival_us long, expected_us long")


BUFFER = 10_000  # rows of a patient that are put into the state together
CROWDED = 4_000  # moves in one slot from which a patient's slots become narrower
WIDTHS = (64, 44, 42, 40, 38, 36, 34, 32)  # slots are 2 ** n microseconds wide: all time, 204 days to 72 minutes
ALL = -2 ** 63  # where the widest slot starts


def _in_order(move):
    """Moves by time and id, no id first."""
    return move[0], move[1] is not None, move[1] or ""


def _slot(us, width):
    return ALL if width == WIDTHS[0] else us >> width << width


class OverdueProcessor(StatefulProcessor):
    """Reports a stay when event time passes its expected end and no other move lies before that.

    Event time is cut into slots. State of a patient, keyed by the time at which a slot starts:

    * `moves`: the time and id of the arrivals and discharges in the slot; the entry of the widest slot, `ALL`,
      also has the width in use and, per slot in use, the first time at which something in it can be decided or dropped;
    * `due`: the stays that begin in the slot and are not decided yet.

    A call of the state costs far more than one more row in it, so a patient's rows share slots: most patients
    have the widest only, those of a busy patient get narrower as they fill. One timer per patient is set, on the
    first of the slots' times. When it fires, every stay that event time has passed by then is decided, and what ended
    in time is dropped, as are the moves behind event time that belong to no open stay (the state's time to live):
    rows to come are newer, and nothing lies between an open stay's arrival and event time.

    Rows are taken in any order; a buffer of them and a slot or two are held at a time. Grouping, shuffle, state
    store and timers are Spark's.
    """

    def init(self, handle):
        self._handle = handle
        self._moves = handle.getMapState("moves", "start long", "found array<struct<us: long, id: string>>, width int, "
                                                                "slots array<struct<start: long, at: long>>")
        self._due = handle.getMapState("due", "start long", "stays array<struct<us: long, id: string, dept: string, until: long>>")

    def _open(self):
        """Reads the entry of the widest slot; it is written by `_keep`. Returns width and slots."""
        found, width, slots = self._moves.getValue((ALL,)) or ((), WIDTHS[0], ())
        self._widest = [tuple(m) for m in found]
        return width, {s[0]: s[1] for s in slots}

    def _keep(self, width, slots, timer=None):
        """Writes what `_open` read, and sets the timer in place of the one given."""
        if not slots:
            self._moves.removeKey((ALL,))
            return
        self._moves.updateValue((ALL,), (self._widest, width, list(slots.items())))
        first = min(slots.values())
        if first != timer:
            if timer is not None:
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(first)

    def _found(self, start):
        if start == ALL:
            return self._widest
        return [tuple(m) for m in self._moves.getValue((start,))[0]]

    def _stays(self, start):
        held = self._due.getValue((start,))
        return [tuple(s) for s in held[0]] if held else []

    def _write(self, start, moves):
        if start == ALL:
            self._widest = moves
        else:
            self._moves.updateValue((start,), (moves, None, None))

    def _drop(self, slots, start, stays):
        del slots[start]
        if start == ALL:
            self._widest = []
        else:
            self._moves.removeKey((start,))
        if stays:
            self._due.removeKey((start,))

    def _take(self, slots, start):
        moves, stays = self._found(start), self._stays(start)
        self._drop(slots, start, stays)
        return moves, stays

    @staticmethod
    def _first(moves, stays):
        """When the first of these stays is due or the first move of no stay is behind event time."""
        own = {(s[0], s[1]) for s in stays}
        return min([-(-s[3] // 1000) for s in stays] + [m[0] // 1000 + 1 for m in moves if m not in own])

    def _add(self, width, slots, moves, stays):
        """Puts moves and stays into their slots; the most moves that one of these now has."""
        new, most = {}, 0
        for kind, items in enumerate((moves, stays)):
            for x in items:
                new.setdefault(_slot(x[0], width), ([], []))[kind].append(x)
        for start, (moves, stays) in new.items():
            at = self._first(moves, stays)
            if start in slots:
                at = min(at, slots[start])
                moves = self._found(start) + moves
                stays = stays and self._stays(start) + stays
            slots[start] = at
            self._write(start, moves)
            if stays:
                self._due.updateValue((start,), (stays,))
            most = max(most, len(moves))
        return most

    def _put(self, width, slots, moves, stays):
        most = self._add(width, slots, moves, stays)
        while most > CROWDED and width > WIDTHS[-1]:
            width = WIDTHS[WIDTHS.index(width) + 1]  # a new slot lies within the old one that it comes from
            most = max(self._add(width, slots, *self._take(slots, start)) for start in list(slots))
        return width

    def handleInputRows(self, key, rows, timerValues):
        width, slots = self._open()
        timer = min(slots.values(), default=None)
        moves, stays = [], []
        for m in rows:
            moves.append((m.event_us, m.event_id))
            if m.expected_us is not None:
                stays.append((m.event_us, m.event_id, m.dept_id, m.expected_us))
            if len(moves) == BUFFER:
                width = self._put(width, slots, moves, stays)
                moves, stays = [], []
        if moves:
            width = self._put(width, slots, moves, stays)
        self._keep(width, slots, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        width, slots = self._open()
        later = None  # the first move of the slots after this one
        for start in sorted(slots, reverse=True):
            if start >= now * 1000 and slots[start] > now:
                continue
            moves, stays = sorted(self._found(start), key=_in_order), self._stays(start)
            order, still = [_in_order(m) for m in moves], []
            for stay in stays:
                us, event, dept, until = stay
                follows = bisect_right(order, _in_order(stay))
                next_us = moves[follows][0] if follows < len(moves) else later
                if next_us is not None and next_us < until:
                    continue
                if until <= now * 1000:
                    yield Row(hospital_id=key[0], patient_id=key[1], dept_id=dept, event_id=event, arrival_us=us, expected_us=until)
                else:
                    still.append(stay)
            later = moves[0][0]
            own = {(s[0], s[1]) for s in still}
            kept = [m for m in moves if m[0] >= now * 1000 or m in own]
            if not kept:
                self._drop(slots, start, stays)
                continue
            if len(kept) < len(moves):
                self._write(start, kept)
            if still and len(still) < len(stays):
                self._due.updateValue((start,), (still,))
            elif stays and not still:
                self._due.removeKey((start,))
            slots[start] = self._first(kept, still)
        self._keep(width, slots)

    def close(self):
        pass


def overdue_stream(events, ts="event_ts"):
    """Patients still present after their expected end (append mode, event-time timers).

    A stay without an expected length is due at once."""
    us = S.micros(ts)
    rows = (watermarked(events, ts).filter(F.col("event_type").isin("arrival", "discharge"))
            .select("hospital_id", "patient_id", "dept_id", "event_id", ts, us.alias("event_us"),
                    F.when(F.col("event_type") == "arrival",  # of discharges it is null
                           us + F.floor(F.coalesce("expected_los_minutes", F.lit(0.0)) * 6e7).cast("long"))
                    .alias("expected_us")))
    late = rows.groupBy("hospital_id", "patient_id").transformWithState(
        statefulProcessor=OverdueProcessor(), outputStructType=OVERDUE_SCHEMA,
        outputMode="append", timeMode="EventTime")
    return late.select("hospital_id", "patient_id", "dept_id", "event_id",
                       F.timestamp_micros("arrival_us").alias("arrival_ts"),
                       F.timestamp_micros("expected_us").alias("expected_end"))


_STAY = ["hospital_id", "patient_id", "dept_id", "event_id", "event_type", "event_ts", "arrival_ts",
         "expected_end"]


def overdue_body(spark, held, out, delay_minutes=10):
    """A foreachBatch body with the same result: open stays are carried from batch to batch.

    A stay is reported when the patient's next arrival or discharge comes after its expected end,
    or when event time minus the delay has passed it. What is still open goes to one folder per
    batch, so a replay starts from the same state.
    """
    def body(df, batch_id):
        moves = df.filter(F.col("event_type").isin("arrival", "discharge"))
        rows = census.expected_end(moves).select(*_STAY)
        if batch_id > 0:
            rows = rows.unionByName(spark.read.parquet(f"{held}/open/batch={batch_id - 1}"))
        near = scans.neighbour(rows, ["hospital_id", "patient_id"], ["event_ts", "event_id"],
                               "event_ts", "event_ts", "next_ts", span="month")
        path = f"{held}/stays/batch={batch_id}"
        near.write.mode("overwrite").parquet(path)
        near = spark.read.parquet(path)
        clock = near.agg((F.max("event_ts") - F.make_dt_interval(mins=F.lit(delay_minutes))).alias("now"))
        if batch_id > 0:  # event time does not go back when a batch holds older rows only
            clock = clock.unionByName(spark.read.parquet(f"{held}/clock/batch={batch_id - 1}")).agg(F.max("now").alias("now"))
        clock.coalesce(1).write.mode("overwrite").parquet(f"{held}/clock/batch={batch_id}")
        now = spark.read.parquet(f"{held}/clock/batch={batch_id}").scalar()
        stays = near.filter(F.col("event_type") == "arrival").withColumn("_now", now)
        nothing = F.col("next_ts").isNull()
        passed = F.coalesce("next_ts", "_now") >= F.col("expected_end")
        sinks.append_batch(stays.filter(passed).select(
            "hospital_id", "patient_id", "dept_id", "event_id", "arrival_ts", "expected_end"), out, batch_id)
        stays.filter(nothing & ~passed).select(*_STAY).write.mode("overwrite").parquet(
            f"{held}/open/batch={batch_id}")
        for folder in ("stays", "open", "clock"):
            remove(spark, f"{held}/{folder}/batch={batch_id - 2}")
    return body
