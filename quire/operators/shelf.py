"""Shelves: listings with visibility, slots and labels, positions, paging and grid geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.ranks import numbered

#: What a listing sorts by where a book has no place: shelf of public and of own books, and the order of a slot.
PUBLIC_SHELF, USER_SHELF, NO_ORDER = "00-public", "90-user", 9999


def is_visible(owner: Column, user: int | None) -> Column:
    """Rows without an owner are public; others are their owner's."""
    return owner.isNull() if user is None else owner.isNull() | (owner == user)


def access(books: DataFrame, user: int | None) -> DataFrame:
    """Books with ``accessible``."""
    return books.withColumn("accessible", is_visible(F.col("user_id"), user))


def own_labels(labels: DataFrame, user: int | None) -> DataFrame:
    """The user's labels by slot; an anonymous user (-1) has none.  Filtered before the join, so that slots without a label stay."""
    return labels.where(F.col("user_id") == (-1 if user is None else user)).select(F.col("slot_id").alias("label_slot"), F.col("label").alias("user_label"))


def visible_label() -> Column:
    """A public slot shows its own label, a private one the user's."""
    return F.when(F.col("is_public") == 1, F.col("slot_label")).otherwise(F.col("user_label"))


def listing(books: DataFrame, placements: DataFrame, slots: DataFrame, labels: DataFrame, shelves: DataFrame, user: int | None) -> DataFrame:
    """Visible books with shelf, slot and label, in the order of the listing; a book on several shelves is there once for each."""
    placed = placements.select(F.col("book_id").alias("placed_book"), F.col("slot_id").alias("placed_slot"), F.col("position").alias("slot_position"))
    slot = slots.select(F.col("id").alias("slot_id"), F.col("shelf_id").alias("slot_shelf"), "row", "col", "sort_order", F.col("label").alias("slot_label"), "is_public")
    shelf = shelves.select(F.col("book_id").alias("shelf_book"), F.col("shelf_id").alias("on_shelf"), F.col("position").alias("on_position"))
    rows = (
        books.where(is_visible(F.col("user_id"), user))
        .join(placed, F.col("id") == F.col("placed_book"), "left").join(slot, F.col("placed_slot") == F.col("slot_id"), "left")
        .join(own_labels(labels, user), F.col("slot_id") == F.col("label_slot"), "left").join(shelf, F.col("id") == F.col("shelf_book"), "left")
    )
    keys = [
        F.when(F.col("slot_id").isNotNull(), 0).when(F.col("on_shelf").isNotNull(), 1).otherwise(2),
        F.coalesce("slot_shelf", "on_shelf", F.when(F.col("user_id").isNull(), PUBLIC_SHELF).otherwise(USER_SHELF)),
        F.coalesce("sort_order", F.lit(NO_ORDER)), F.coalesce("slot_position", "on_position", "display_order", F.lit(0)),
    ]
    return rows.select(
        *[F.col(c) for c in books.columns], F.coalesce("slot_shelf", "on_shelf").alias("shelf_id"), F.coalesce("slot_position", "on_position").alias("shelf_position"),
        F.col("slot_id").alias("shelf_slot_id"), F.col("row").alias("shelf_row"), F.col("col").alias("shelf_col"), visible_label().alias("shelf_slot_label"),
        *[k.alias(f"key{n}") for n, k in enumerate(keys)], "on_shelf",
    ).orderBy("key0", "key1", "key2", "key3", F.col("display_order").asc_nulls_first(), F.col("created_at").asc_nulls_first(), "id", F.col("on_shelf").asc_nulls_first()).drop("key0", "key1", "key2", "key3", "on_shelf")


def slot_list(slots: DataFrame, labels: DataFrame, shelf: str, user: int | None) -> DataFrame:
    rows = slots.where(F.col("shelf_id") == shelf).withColumnRenamed("label", "slot_label").join(own_labels(labels, user), F.col("id") == F.col("label_slot"), "left")
    return rows.select("id", "shelf_id", "row", "col", "sort_order", visible_label().alias("label"), "is_public")


def resolve_slot(asked: DataFrame, slots: DataFrame) -> DataFrame:
    """Asked (request, slot_id, row, col) with ``found``: the slot by id if its coordinates agree, else by coordinates; public slots are refused (null)."""
    by_id = slots.select(F.col("id").alias("id_a"), F.col("row").alias("row_a"), F.col("col").alias("col_a"), F.col("is_public").alias("public_a"))
    by_place = slots.select(F.col("id").alias("id_b"), F.col("row").alias("row_b"), F.col("col").alias("col_b"), F.col("is_public").alias("public_b"))
    rows = asked.join(by_id, (F.col("slot_id") == F.col("id_a")) & (F.col("row") == F.col("row_a")) & (F.col("col") == F.col("col_a")), "left")
    rows = rows.join(by_place, (F.col("row") == F.col("row_b")) & (F.col("col") == F.col("col_b")), "left")
    public = F.coalesce("public_a", "public_b", F.lit(0))
    return rows.select(*asked.columns, F.when(public == 0, F.coalesce("id_a", "id_b")).alias("found"))


def next_ordinal(rows: DataFrame, column: str, first: int, keys: list[str]) -> DataFrame:
    """For each key, one more than the largest ordinal so far, or ``first``."""
    return rows.groupBy(*keys).agg((F.coalesce(F.max(column), F.lit(first - 1)) + 1).cast("long").alias("next_ordinal"))


def created_slots(slots: DataFrame, wanted: DataFrame) -> DataFrame:
    """slots (shelf_id, row, col, sort_order, label) and those of wanted (shelf_id, row, col) that are not there yet, without a label and after the others of their shelf.

    A slot that several ask for is created once, and asking again changes nothing.
    """
    at = ["shelf_id", "row", "col"]
    new = wanted.select(*at).distinct().join(slots.select(*at), at, "left_anti")
    last = slots.groupBy(F.col("shelf_id").alias("of")).agg(F.max("sort_order").alias("last"))
    place = F.row_number().over(Window.partitionBy("shelf_id").orderBy("row", "col"))
    rows = new.join(last, F.col("shelf_id") == F.col("of"), "left").withColumn("sort_order", F.coalesce("last", F.lit(-1)) + place)
    kinds = {f.name: f.dataType for f in slots.schema}
    return slots.unionByName(rows.select(*[F.lit(None).cast(kinds[c]).alias(c) if c not in (*at, "sort_order") else F.col(c).cast(kinds[c]).alias(c) for c in slots.columns]))


def locale_order(column: str) -> Column:
    """What listings of titles sort by: letters by language rules, not by code points."""
    return F.collate(F.col(column), "UNICODE")


def insert_at(siblings: DataFrame, book_id: int, at: int) -> DataFrame:
    """Siblings (book_id, position) and the book itself: it goes to place ``at`` (clamped), those from there on move right; positions count from 0."""
    others = siblings.where(F.col("book_id") != book_id)
    ranked = numbered(others, [], ["position", "book_id"])
    moved = ranked.select("book_id", (F.col("at") + F.when(F.col("at") >= F.least(F.lit(max(0, at)), F.col("n")), 1).otherwise(0)).cast("long").alias("position"))
    place = others.agg(F.least(F.lit(max(0, at)), F.count("*")).cast("long").alias("position"))
    return moved.unionByName(place.select(F.lit(book_id).cast("long").alias("book_id"), "position"))


def moved(placements: DataFrame, moves: DataFrame) -> DataFrame:
    """placements (book_id, slot_id, position) after ``moves`` (book_id, slot_id, insert_index), at most one into a slot and one of a book.

    All moved books leave their slots first.  A book lands where the sibling at its index stands, behind the last if there is none, at 0 in an empty slot; siblings from
    there on move right by one, and gaps stay.  Slots of any size are ranked in ranges.
    """
    others = placements.join(moves.select("book_id"), "book_id", "left_anti")
    into = moves.select(F.col("book_id").alias("mover"), F.col("slot_id").alias("into"), "insert_index")
    ranked = numbered(others.join(into.select("into"), F.col("slot_id") == F.col("into"), "left_semi"), ["slot_id"], ["position", "book_id"])
    held = ranked.join(into, F.col("slot_id") == F.col("into")).groupBy("mover").agg(
        F.max(F.when(F.col("at") == F.greatest("insert_index", F.lit(0)), F.col("position"))).alias("there"), (F.max("position") + 1).alias("behind")
    )
    landed = into.join(held, "mover", "left").select("mover", "into", F.coalesce("there", "behind", F.lit(0)).cast("long").alias("lands"))
    shift = others.join(landed.select("into", "lands"), F.col("slot_id") == F.col("into"), "left")
    right = F.when(F.col("position") >= F.col("lands"), 1).otherwise(0)
    return shift.select("book_id", "slot_id", (F.col("position") + right).cast("long").alias("position")).unionByName(landed.select(F.col("mover").alias("book_id"), F.col("into").alias("slot_id"), F.col("lands").alias("position")))


def occupancy(placements: DataFrame, books: DataFrame, user: int) -> DataFrame:
    """Books of each slot: all, and the user's own."""
    rows = placements.join(books.select(F.col("id").alias("b"), "user_id"), F.col("book_id") == F.col("b"))
    return rows.groupBy("slot_id").agg(F.count("*").alias("total"), F.sum(F.when(F.col("user_id") == user, 1).otherwise(0)).alias("mine"))


def pages(books: DataFrame, order: list[str], n: int) -> DataFrame:
    """Page and row of a wall of books: page 0 has the public row and the first n own books, later pages have two rows of n."""
    ranked = numbered(books.withColumn("own", F.col("user_id").isNotNull()), ["own"], order)
    own, at = F.col("own"), F.col("at")
    later = at - n
    page = F.when(~own | (at < n), 0).otherwise(1 + F.floor(later / (2 * n)))
    row = F.when(~own, 0).when(at < n, 1).otherwise(F.floor((later % (2 * n)) / n))
    return ranked.select(*books.columns, page.cast("long").alias("page"), row.cast("long").alias("page_row"))


def midpoint_positions(rows: DataFrame, keys: list[str], position: str, order: list[str]) -> DataFrame:
    """Where a book dropped before each row would go: between it and its left neighbour, or half a step before the first."""
    before = F.lag(position).over(Window.partitionBy(*keys).orderBy(position, *order))
    return rows.withColumn("drop_position", F.when(before.isNull(), F.col(position) - 0.5).otherwise((before + F.col(position)) / 2))


def bays(books: DataFrame, width: Column) -> DataFrame:
    """Width taken in each bay, and the number of books."""
    return books.groupBy("row", "col").agg(F.sum(width).alias("run_width"), F.count("*").alias("books"))


def extents(bays_: DataFrame) -> DataFrame:
    return bays_.agg(F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("col").alias("min_col"), F.max("col").alias("max_col"))


def drop_targets(bays_: DataFrame, capacity: float, needed: float) -> DataFrame:
    """The grid of bays with one empty ring around it, with the width that remains, where the needed width fits."""
    edge = extents(bays_)
    rows = edge.select(F.explode(F.sequence(F.col("min_row") - 1, F.col("max_row") + 1)).alias("row"), "min_col", "max_col")
    grid = rows.select("row", F.explode(F.sequence(F.col("min_col") - 1, F.col("max_col") + 1)).alias("col"))
    taken = bays_.select(F.col("row").alias("r"), F.col("col").alias("c"), "run_width")
    full = grid.join(taken, (F.col("row") == F.col("r")) & (F.col("col") == F.col("c")), "left")
    return full.select("row", "col", (F.lit(capacity) - F.coalesce("run_width", F.lit(0.0))).alias("remaining")).where(F.col("remaining") >= needed)


def insert_index(points: DataFrame, books: DataFrame, bay_width: float, bay_height: float, capacity: float) -> DataFrame:
    """For points (point, x, y, width): the bay they fall in, whether the width fits there, and how many books of it lie to the left."""
    at = points.withColumn("col", F.floor(F.col("x") / bay_width + 0.5).cast("long")).withColumn("row", F.floor(F.col("y") / bay_height + 0.5).cast("long"))
    own = books.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("x").alias("book_x"), F.col("width").alias("book_width"))
    rows = at.join(own, (F.col("row") == F.col("r")) & (F.col("col") == F.col("c")), "left").groupBy("point", "x", "width", "row", "col")
    return rows.agg(
        (F.coalesce(F.sum("book_width"), F.lit(0.0)) + F.col("width") <= capacity).alias("fits"), F.sum(F.when(F.col("book_x") < F.col("x"), 1).otherwise(0)).cast("long").alias("insert_index")
    ).select("point", "row", "col", "fits", "insert_index")
