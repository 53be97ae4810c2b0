"""Empty on purpose: listings arrive as stored files, and no operator here is a stream."""
