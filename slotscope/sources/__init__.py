"""Reading and writing snapshots, job history, logs and configuration."""
