"""Column expressions shared by the operators; none of them starts a job."""
