"""Named queries over the driver's tables, each with independent SQL where SQL can express it."""
