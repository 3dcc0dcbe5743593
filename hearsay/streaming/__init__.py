"""The series tables as streams, and the sinks that keep them exact."""
