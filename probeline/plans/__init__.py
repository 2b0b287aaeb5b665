"""Named queries: one logical result each, in as many plan shapes as there are approaches."""
