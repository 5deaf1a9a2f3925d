"""flowpane: window analytics over labelled, time-ordered flow tables, as Spark DataFrame operators."""
