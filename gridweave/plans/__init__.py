"""Named queries of the engine, with SQL that gives the same rows where SQL can."""
