"""gridloom: a batch analytics engine for annotation benchmarks, declared as Spark plans."""
