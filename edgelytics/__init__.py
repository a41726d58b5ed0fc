"""Analytics over large weighted, attributed, directed edge tables with PySpark."""
