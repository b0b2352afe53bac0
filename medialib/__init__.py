"""Analytics over large libraries of saved media posts, as Spark jobs."""
